"""The pipeline against its definition, and the registered queries against DuckDB, on the small test tables."""

import hashlib
import os
import re
import sys

import public_tokenizers
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from compare import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from shoal.llm import queries, tiling  # noqa: E402
from shoal.llm.scratch import saved, table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def shingles(text, n):
    parts = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(parts[k:k + n]) for k in range(max(1, len(parts) - n + 1))} if parts else set()


def test_every_stage_keeps_what_it_should(spark):
    import tiktoken

    docs = table(spark, SF_DIR, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(saved(stage(spark, kept[-1], SF_DIR), name))
    assert all(k.columns == columns for k in kept[:-1])
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]

    toxic = {r.doc_id for r in table(spark, SF_DIR, "labels").filter("toxic = 1").collect()}
    gone = set(texts[0]) - set(texts[1])
    assert len(gone & toxic) >= 0.6 * len(toxic & set(texts[0])) and len(gone) <= 0.25 * len(texts[0])

    first = {}
    for i in sorted(texts[1]):
        first.setdefault(SPACE.sub(" ", texts[1][i]), i)
    assert set(texts[2]) == set(first.values())

    sets = {i: shingles(t, 5) for i, t in texts[2].items()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert set(texts[3]) == {i for i in sets if root[i] == i}

    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in table(spark, SF_DIR, "benchmark").collect()]
    whole = {i for i, t in texts[3].items() if any(x in " ".join(re.findall(r"[^\W_]+", t.lower())) for x in items)}
    assert whole <= set(texts[3]) - set(texts[4])
    assert set(texts[3]) - set(texts[4]) == {r.doc_id for r in tiling.leaks(kept[3], table(spark, SF_DIR, "benchmark")).collect()}

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        from shoal.llm.bpe import parse_ranks

        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    got = {r.doc_id: r for r in kept[-1].collect()}
    assert set(got) == set(texts[4])
    for i, t in texts[4].items():
        ids = library.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.SQL[name]) is None


def test_a_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
