"""Language by compression.

Each language has a zstandard dictionary of raw content: texts of that language. A text is compressed with every one, after
a passage of the same language that sets the coder's tables and whose own size is taken off, and the language that makes
it smallest is its own. Where that leaves under `FINE_BYTES` bytes, a few bytes decide, and the sizes after `CONTEXTS`
passages are averaged instead. If the runner-up needs hardly more bytes (a share under `margin`),
the answer is rejected as uncertain: it is still reported, with `rejected` true.

The dictionaries are made from a sample of labelled rows: up to about `sample_docs` documents of a language, the first
`sample_chars` characters of each, up to `dict_bytes` bytes; the sample is fixed by the ids. They are sent to the
executors, so their size is bounded by the number of languages. Every text is compressed whole.

A text that is null or without a letter is `und` with score 0, as is every text if there are no labelled ones. Ties go to the
language first in alphabetical order. Null and repeated ids are kept, a row of the result to each row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import share

DICT_BYTES = 110_000
SAMPLE_DOCS = 150
SAMPLE_CHARS = 4000
LEVEL = 3
FINE_LEVEL = 5
FINE_BYTES = 250
CONTEXTS = 8
CONTEXT_BYTES = 1500
MARGIN = 0.01
SHARPNESS = 0.5


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, tuple[bytes, bytes]]:
    """(passages, dictionary content) of each language in the rows that are labelled. The driver receives the sample only."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return {}
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, sample_docs / n)])[F.col(lang)]
    sample = rows.filter(share(F.col(doc_id)) < part).select(
        F.col(lang).alias("lang"), F.substring(text, 1, sample_chars).alias("text"), F.xxhash64(doc_id).alias("at"))
    by_lang: dict[str, list] = {k: [] for k in counts}
    for row in sample.distinct().collect():
        by_lang[row.lang].append((row.at, row.text))
    out = {}
    for k in sorted(by_lang):
        parts, size, passages = [], 0, b""
        for content in dict.fromkeys(t for _, t in sorted(by_lang[k])):
            data = content.lower().encode() + b"\n"
            if len(passages) < CONTEXTS * CONTEXT_BYTES and parts:
                passages += data[:CONTEXT_BYTES]
            elif size + len(data) <= dict_bytes:
                parts.append(data)
                size += len(data)
        if parts:
            out[k] = passages or parts[0], b"".join(parts)
    return out


class Compressors:
    def __init__(self, contents: dict[str, tuple[bytes, bytes]]):
        self.langs = sorted(contents)
        self.coarse = [self._made(contents[k][1], LEVEL) for k in self.langs]
        self.fine = [self._made(contents[k][1], FINE_LEVEL) for k in self.langs]
        self.contexts = []
        for k in self.langs:
            text = contents[k][0]
            n = max(1, min(CONTEXTS, len(text) // CONTEXT_BYTES))
            self.contexts.append([text[j * len(text) // n:(j + 1) * len(text) // n] for j in range(n)])
        self.coarse_own = [len(c.compress(x[0])) for c, x in zip(self.coarse, self.contexts)]
        self.fine_own = [sum(len(c.compress(x)) for x in xs) for c, xs in zip(self.fine, self.contexts)]

    @staticmethod
    def _made(content: bytes, level: int):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False)

    def sizes(self, text: str) -> list[float]:
        data = text.lower().encode()
        out = [float(len(c.compress(x[0] + data)) - own) for c, x, own in zip(self.coarse, self.contexts, self.coarse_own)]
        if min(out) < FINE_BYTES:
            out = [(sum(len(c.compress(x + data)) for x in xs) - own) / len(xs)
                   for c, xs, own in zip(self.fine, self.contexts, self.fine_own)]
        return out


def verdict(langs: list[str], sizes: list[float], margin: float, sharpness: float = SHARPNESS) -> tuple[str, float, bool]:
    """(language, score, rejected): the score weighs each language by exp of the bytes it needs more than the best."""
    best = min(range(len(sizes)), key=lambda k: sizes[k])
    rest = [n for k, n in enumerate(sizes) if k != best]
    score = 1.0 / (1.0 + sum(math.exp(-sharpness * (n - sizes[best])) for n in rest))
    return langs[best], score, bool(rest) and (min(rest) - sizes[best]) < margin * abs(min(rest))


_workers: dict[str, Compressors] = {}


def predicted(docs: DataFrame, contents: dict[str, tuple[bytes, bytes]], text: str = "text", doc_id: str = "doc_id",
              held_out: Column | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(contents)
    name = hashlib.sha256(repr(sorted(contents.items())).encode()).hexdigest()
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"))

    def run(batches):
        key = name
        if key not in _workers:
            _workers.clear()
            _workers[key] = Compressors(held.value)
        compressors = _workers[key]
        for batch in batches:
            out = []
            for value in batch.column("text").to_pylist():
                if not compressors.langs or not value or not any(map(str.isalpha, value)):
                    out.append(("und", 0.0, False))
                else:
                    out.append(verdict(compressors.langs, compressors.sizes(value), margin))
            langs, scores, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
