"""Merkle manifests against trees built by definition, and the layout against a recursive walk."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shoal.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars int, text string, key string, rank long, n int, _line double, leaf string"


def documents(spark, rows):
    """Documents with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "k", 1, 2, 0.5, "l") for r in rows], DOCS)


def odd_rows(n):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "é", "Z", "zz", ""]), rng.choice(["en", None]), i, f"Text {i} Ä") for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, None, "en", 0, ""), (n + 2, "single", "en", 3, "B" * 50_000)]
    rows += [(n + 3, "a", "en", 1, "copy"), (n + 3, "a", "en", 1, "copy"), (n + 3, "a", "en", 1, "Copy"), (None, "a", "en", 1, "x")]
    return rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(leaves):
    """Root over digests and, for each, the list of (before, after) on its way."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16:i // 16 * 16 + 16]
            paths[k].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


@pytest.mark.parametrize("height", [1, 2, 3, 4, 5])
def test_layout_splits_at_half_height(height):
    def walk(h, depth, index):
        """Nodes in the order of the layout, as (depth, index)."""
        if h == 1:
            return [(depth, index)]
        out = walk(h // 2, depth, index)
        below = manifest.FANOUT ** (h // 2)
        for k in range(below):
            out += walk(h - h // 2, depth + h // 2, index * below + k)
        return out

    order = walk(height, 0, 0) if height < 5 else walk(height, 0, 0)[:5000]
    assert [manifest.address(height, d, i) for d, i in order] == list(range(len(order)))


@pytest.mark.parametrize("n, levels", [(400, 1), (700, 2), (60, 3)])
def test_proofs(spark, n, levels):
    rows = odd_rows(n)
    lower = F.lower("text")
    fields = [lower if c == "text" else F.col(c) for c in manifest.FIELDS]
    checked = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf(*fields))
    made = manifest.manifest(documents(spark, rows), checked=checked, levels=levels)
    got = sorted((tuple(r) for r in manifest.proofs(made, levels).collect()), key=repr)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources]
    trees = [brute([leaf_of(r) for r in g]) for g in groups]
    root, upper = brute([t[0] for t in trees])
    want = []
    for group, (subroot, paths), above in zip(groups, trees, upper):
        for row, path in zip(group, paths):
            way = path + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            fold = leaf_of((*row[:4], row[4].lower() if tampered and row[4] is not None else row[4]))
            for before, after in way:
                fold = sha(before + fold + after)
            want.append((row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in way)), fold, fold == root))
    assert got == sorted(want, key=repr)


def test_empty_and_single(spark):
    none = documents(spark, [])
    assert manifest.proofs(manifest.manifest(none)).count() == 0
    one = manifest.proofs(manifest.manifest(documents(spark, [(1, "a", None, 2, "x")]))).collect()
    digest = leaf_of((1, "a", None, 2, "x"))
    assert [tuple(r) for r in one] == [(1, digest, digest, digest, sha(""), digest, True)]
