"""Registered queries of the operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import adaptjoin, bpe, disclosure, fixity, impact, manifest, markup, radix, simple8b, tiling, trie, weak, zlang
from shoal.llm.scratch import bucket_of, table
from shoal.session import scratch_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    return weak.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return disclosure.report(disclosure.spans(docs, disclosure.telling_terms(docs)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    return zlang.predicted(docs, zlang.dictionaries(docs.filter(~held_out)), held_out=held_out)


def op4_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.extracted(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptjoin.similar_groups(table(spark, sf_dir, "documents"), 4, 85)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    files = simple8b.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return simple8b.read_ids(spark, files)


def _drilled(page_id: int | None) -> int:
    """Which records a drill damages, about one of 61, chosen by page_id: 1 before they are compressed, 2 as stored, 0 not at all."""
    number = 1 if page_id is None else int(hashlib.md5(str(page_id).encode()).hexdigest()[:8], 16)
    return 0 if number % 61 else 1 + number // 61 % 2


def _flipped(page_id: int | None, record: bytes) -> bytes:
    """A drill: one bit of the payload's middle byte is flipped."""
    if _drilled(page_id) != 1:
        return record
    at = (record.find(b"\r\n\r\n") + 4 + len(record) - 4) // 2
    return record[:at] + bytes([record[at] ^ 1]) + record[at + 1:]


def _flipped_stored(page_id: int | None, stored: bytes) -> bytes:
    """A drill: one bit of the gzip member is flipped, from its middle byte on the first that makes it unreadable."""
    if _drilled(page_id) != 2:
        return stored
    for at in range(len(stored) // 2, len(stored)):  # a flip in the closing checksum always does
        other = stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1:]
        if fixity.unpacked(other) is None:
            return other
    return stored


def op8_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an archive, a replica with some damaged records, and what the audit of the two finds."""
    ours = fixity.write_archive(table(spark, sf_dir, "pages"), scratch_path(spark, "archive"))
    theirs = fixity.replicate(ours, scratch_path(spark, "replica"), _flipped, _flipped_stored)
    found = fixity.audit(fixity.leaves(ours), fixity.leaves(theirs))
    return found.select("page_id", "problem", "damaged", "payload_bytes", "payload_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_groups(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, max_states=400_000, max_words=400_000)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.grafted_sequences(trie.turns_of(table(spark, sf_dir, "conversations"))))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and a check of it against a copy in which every fifth text (by doc_id) is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    copy = [lower if c == "text" else F.col(c) for c in manifest.FIELDS]
    checked = F.when(bucket_of(F.col("doc_id"), 5) == 0, manifest.leaf(*copy))
    return manifest.proofs(manifest.manifest(docs, checked=checked)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_disclosure": op2_disclosure,
    "op3_language": op3_language,
    "op4_benchmark_tiling": op4_benchmark_tiling,
    "op5_main_text": op5_main_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_fixity_audit": op8_fixity_audit,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_NORMAL = "regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"


def _crc32(number: str) -> str:
    """SQL of the unsigned crc32 of a number's decimal text."""
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b))"
    return f"""xor(list_reduce(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
        lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


_LEAF = " || ".join(map(_field, manifest.FIELDS))
_TAMPERED = _LEAF.replace(_field("text"), _field(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"))

SQL: dict[str, str] = {
    "op8_fixity_audit": """
SELECT page_id, 'changed' AS problem, 'theirs' AS damaged, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_sha256
FROM pages WHERE CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 61 = 0""",
    "op9_exact_dedup": f"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_NORMAL} AS t FROM documents)
WINDOW w AS (PARTITION BY t)""",
    "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, {_crc32('c')} % 9 AS h, c - c % 5 AS base FROM (SELECT DISTINCT c FROM t)),
heads AS (SELECT cs.c, t.p, t.r, t.x FROM cs JOIN t ON t.c = cs.base AND t.p <= cs.h),
taken AS (SELECT c, count(*) AS b FROM heads GROUP BY c),
rebuilt AS (
  SELECT * FROM heads
  UNION ALL
  SELECT t.c, t.p - cs.h + coalesce(b, 0), r, x FROM t JOIN cs USING (c) LEFT JOIN taken USING (c) WHERE t.p > cs.h),
prefixes AS (
  SELECT c, p AS d, octet_length(encode(x)) AS size,
         md5(string_agg(octet_length(encode(r)) || ':' || r || octet_length(encode(x)) || ':' || x, '') OVER (PARTITION BY c ORDER BY p)) AS k
  FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, '' FROM cs),
last AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
nodes AS (SELECT k, min(c) AS c, any_value(d) AS d, count(*) AS n, any_value(size) AS size FROM prefixes GROUP BY k),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM prefixes JOIN last USING (c, d) GROUP BY k),
linked AS (
  SELECT n.*, o.k AS above, m.c AS over
  FROM nodes AS n LEFT JOIN prefixes AS o ON o.c = n.c AND o.d = n.d - 1 LEFT JOIN nodes AS m ON m.k = o.k),
children AS (SELECT above AS k, count(*) AS n_children FROM linked WHERE above IS NOT NULL GROUP BY above),
full_nodes AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked AS l LEFT JOIN children USING (k)),
sums AS (
  SELECT o.k, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n - 1) * n.size) AS saved
  FROM full_nodes AS n JOIN prefixes AS o ON o.c = n.c AND o.d <= n.d GROUP BY o.k)
SELECT n.c AS conv_id, n.d AS depth, n.over AS parent_conv_id, n.n AS n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes AS n JOIN sums AS s USING (k) LEFT JOIN ends AS e USING (k)""",
    "op12_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS key, sha256({_LEAF}) AS h,
         CASE WHEN {_crc32('doc_id')} % 5 = 0 THEN sha256({_TAMPERED}) ELSE sha256({_LEAF}) END AS checked
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM leaves),
tree AS (
  SELECT key, 0 AS lvl, idx, h, n FROM ranked
  UNION ALL
  SELECT key, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16
  FROM tree WHERE n > 1 GROUP BY key, lvl, idx // 16),
subroots AS (SELECT key, h, row_number() OVER (ORDER BY encode(key)) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 'all' AS key, 0 AS lvl, idx, h, n FROM subroots
  UNION ALL
  SELECT key, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY key, lvl, idx // 16),
steps AS (
  SELECT key, lvl, idx, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM (SELECT * FROM tree UNION ALL SELECT * FROM top) AS t WHERE n > 1
  WINDOW w AS (PARTITION BY key, lvl, idx // 16 ORDER BY idx)),
climbed AS (
  SELECT r.doc_id, r.key, 0 AS lvl, r.idx, r.n, r.checked AS h, '' AS proof, false AS above FROM ranked AS r
  UNION ALL
  SELECT c.doc_id, CASE WHEN c.n > 1 THEN c.key ELSE 'all' END, CASE WHEN c.n > 1 THEN c.lvl + 1 ELSE 0 END,
         CASE WHEN c.n > 1 THEN c.idx // 16 ELSE s.idx END, CASE WHEN c.n > 1 THEN (c.n + 15) // 16 ELSE s.n END,
         CASE WHEN c.n > 1 THEN sha256(t.a || c.h || t.b) ELSE c.h END, CASE WHEN c.n > 1 THEN c.proof || t.a || t.b ELSE c.proof END,
         c.above OR c.n = 1
  FROM climbed AS c LEFT JOIN steps AS t ON t.key = c.key AND t.lvl = c.lvl AND t.idx = c.idx
       LEFT JOIN subroots AS s ON s.key = c.key
  WHERE c.n > 1 OR NOT c.above)
SELECT r.doc_id, r.h AS leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM ranked AS r JOIN subroots AS s USING (key) JOIN (SELECT * FROM climbed WHERE above AND n = 1) AS c ON c.doc_id = r.doc_id
     CROSS JOIN (SELECT h FROM top WHERE n = 1) AS t""",
}
