"""Prefix tries against sets of tuples, and the minimal perfect hash against its definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shoal.llm import trie

TURNS = "conv_id long, turn int, role string, text string, conv string, n int, pos long, d1 string, len double"


def table(spark, rows):
    """Turns with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "c", 1, 2, "d", 0.5) for r in rows], TURNS)


def odd_rows():
    rng = random.Random(3)
    said = ["", "é", "yes", "no", None, "long " * 2000]
    rows = [(c, k, rng.choice(["user", "bot", None]), rng.choice(said)) for c in range(-12, 60) for k in range(rng.randint(1, 6))]
    rows += [(c, k, "user", "same") for c in range(100, 160) for k in range(4)]  # copies
    rows += [(200, k, "user", str(k)) for k in range(300)]  # a long one
    rows += [(201, None, "user", "first"), (201, 0, "user", "second"), (203, 1, None, None), (None, 0, "user", "x"), (None, None, None, None)]
    rows += [(204, 1, "a", "x"), (204, 1, "a", "x"), (204, 1, "b", "x"), (207, 1, "", "")]
    return rows


def sequences(rows, graft):
    convs = {}
    for c, k, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            sha = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
            convs.setdefault(c, []).append(((k is not None, k or 0, sha), (r, t)))
    convs = {c: [turn for _, turn in sorted(v)] for c, v in convs.items()}
    if not graft:
        return convs
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {node: [node] for node in members}
    for node in members:
        for d in range(len(node)):
            below[node[:d]].append(node)
    children = {node: 0 for node in members}
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved = {node: (len(m) - 1) * len(node[-1][1].encode()) if node else 0 for node, m in members.items()}
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node],
                    sum(children[n] == 0 for n in below[node]), sum(saved[n] for n in below[node]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("graft, unit_rows, shard_nodes", [(True, 1 << 16, 1 << 18), (True, 40, 50), (False, 200, 100), (False, 1, 7)])
def test_trie(spark, graft, unit_rows, shard_nodes):
    rows = odd_rows()
    turns = trie.turns_of(table(spark, rows))
    whole = trie.grafted_sequences(turns) if graft else trie.whole_sequences(turns)
    got = sorted((tuple(r) for r in trie.trie(whole, unit_rows, shard_nodes).collect()), key=repr)
    assert got == brute(sequences(rows, graft))


def test_equal_digests_are_made_anew(spark, monkeypatch):
    """Where two turns hash alike under the first seed, the second is taken."""
    rows = [(c, k, "user", f"{c} {k}") for c in range(10) for k in range(3)]
    plain, seeds = trie.prefixes, []

    def colliding(whole, seed=0):
        seeds.append(seed)
        found = plain(whole, seed)
        return found.withColumns({"d1": found["pos"], "d2": found["pos"]}) if seed == 0 else found

    monkeypatch.setattr(trie, "prefixes", colliding)
    got = trie.trie(trie.whole_sequences(trie.turns_of(table(spark, rows))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(sequences(rows, False))
    assert seeds == [0, 1]


def test_empty(spark):
    assert trie.trie(trie.grafted_sequences(trie.turns_of(table(spark, [])))).count() == 0
    assert trie.trie(trie.grafted_sequences(trie.turns_of(table(spark, [(None, 1, "a", "b")])))).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for _ in range(2))
        slots = trie.Slots(a, b)
        assert sorted(slots.find(a, b).tolist()) == list(range(n))
        assert (slots.find(a, b + 1) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.array([1, 1]), np.array([2, 2]))
