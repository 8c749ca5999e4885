"""Personal data, and terms that give it away.

Patterns find protected entities: e-mail and IP addresses, card and phone numbers. Over all documents the words that stand
near an entity are counted against all documents that hold them. With P(k) the share of documents that hold an entity of kind
k, and P(k | t) the share of those with term t that have it near an entity of kind k, the information
that t gives is log2 P(k | t) / P(k); a term that settles the matter gives all of the entity's own, -log2 P(k). A term
that gives at least `generalise` of it is generalised, at least `remove` removed, if it stands near `min_values`
different entities in `min_docs` documents, so that copies of one document do not make their words telling.

Terms are runs of letters in lower case, known by 64-bit hashes. The counts over all documents pass a bitmap of fixed size,
which lets through every candidate term (and a few others, which a join then drops). Only hashes and counts are shuffled, added up in each batch
before; what comes back to the driver is the bitmap and one count per kind.

Null and empty texts have no spans. Null or repeated ids are kept, a row of the result to each row. Whole texts are
searched, in time linear in their length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import fresh, saved, small
from shoal.llm.words import byte_classes, text_blocks, word_hashes

# The kinds in their order, and the patterns.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

WINDOW = 8
MIN_DOCS = 5
MIN_VALUES = 3
GENERALISE = 0.6
REMOVE = 0.9
BITMAP_BITS = 23
_TABLE = byte_classes(bytes(c for c in range(128) if not chr(c).isalpha()))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the pattern. The characters before an @ are looked at once, from that @ back to the last."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if local else None
        if found:
            yield at - local, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected entities, in code points, by start and then by kind."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)
                    if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text)
                    if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _texts_with_words(column):
    """(text, word hashes, first byte of each word) of each row."""
    values = column.to_pylist()
    for first, _, data, offsets in text_blocks(column):
        hashes, firsts, starts = word_hashes(data, offsets, _TABLE)
        for k in range(len(offsets) - 1):
            a, b = firsts[k], firsts[k + 1]
            yield values[first + k] or "", hashes[a:b], starts[a:b] - offsets[k]


def _value_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _near(batches):
    """(term, kind, value, n): for each document its terms near an entity; with a null term, documents by kind ("" for all).

    A row for each entity (value) that the term stands near; n is 1 in one of them and 0 in the others, so that it adds up to documents.
    """
    for batch in batches:
        terms, kinds, values, firsts, totals = [], [], [], [], {"": batch.num_rows}
        for text, hashes, starts in _texts_with_words(batch.column("text")):
            spans = base_spans(text)
            found: dict[tuple[str, int], set[int]] = {}
            for start, end, kind in spans:
                a = len(text[:start].encode())
                b = a + len(text[start:end].encode())
                left, right = np.searchsorted(starts, [a, b])
                value = _value_of(text[start:end])
                for h in (*hashes[max(0, left - WINDOW):left].tolist(), *hashes[right:right + WINDOW].tolist()):
                    found.setdefault((kind, h), set()).add(value)
            for (kind, h), near in found.items():
                terms += [h] * len(near)
                kinds += [kind] * len(near)
                values += near
                firsts += [1] + [0] * (len(near) - 1)
            for kind in {k for _, _, k in spans}:
                totals[kind] = totals.get(kind, 0) + 1
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(np.array(terms, np.uint64).view(np.int64)), pa.nulls(len(totals), pa.int64())]),
            pa.array([*kinds, *totals]), pa.array([*values, *[0] * len(totals)], pa.int64()),
            pa.array([*firsts, *totals.values()], pa.int64())], names=["term", "kind", "value", "n"])


def _bitmap(terms: DataFrame, bits: int) -> np.ndarray:
    """A bit for each remainder of a term's hash; at most 2**bits of them reach the driver, packed in numbers of 32 bits."""
    place = f"pmod(term, {1 << bits}L)"
    rows = terms.selectExpr(f"cast({place} div 32 as int) at", f"shiftleft(1L, cast({place} % 32 as int)) bit")
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[got["at"].to_numpy()] = got["bit"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def telling_terms(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_values: int = MIN_VALUES,
                  generalise: float = GENERALISE, bits: int = BITMAP_BITS) -> DataFrame:
    """(term, kind, near_docs, docs, disclosure): terms that give at least `generalise` of an entity's information."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    near = saved(rows.mapInArrow(_near, "term long, kind string, value long, n long")
                 .groupBy("term", "kind", "value").agg(F.sum("n").alias("n")), "near")
    totals = {r.kind: r.n for r in near.filter("term is null").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    candidates = saved(
        near.filter("term is not null").groupBy("term", "kind")
        .agg(F.sum("n").alias("near_docs"), F.count("*").alias("entities"))
        .filter((F.col("near_docs") >= min_docs) & (F.col("entities") >= min_values)), "candidates")
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(candidates, bits))

    def count(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, hashes, _ in _texts_with_words(batch.column("text")):
                found.append(np.unique(hashes[held.value[hashes & np.uint64((1 << bits) - 1)] > 0]))
            terms, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    counts = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("docs"))
    everything = totals.get("", 0)
    share = F.create_map(*[F.lit(x) for k, n in totals.items() if k for x in (k, n / everything)]) if len(totals) > 1 else None
    if share is None:
        return candidates.select("term", "kind", "near_docs", F.lit(0).cast("long").alias("docs"), F.lit(0.0).alias("disclosure")).limit(0)
    own = share[F.col("kind")]
    gain = F.log2(F.col("near_docs") / F.col("docs") / own) / -F.log2(own)
    return candidates.join(counts, "term").withColumn("disclosure", F.when(own < 1, gain).otherwise(0.0)).filter(
        F.col("disclosure") >= generalise).select("term", "kind", "near_docs", "docs", "disclosure")


def spans(docs: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id", remove: float = REMOVE,
          bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, base, telling) for each row of `docs`: arrays of (start, kind number, end, kind, action) in order.

    Words that may be terms are found with a bitmap; they then meet the table of terms in a join by hash, which is a
    broadcast where that table is small. Texts are not shuffled.
    """
    acts = saved(terms.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "terms")
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(acts, bits))
    span = "struct<start:long,place:int,end:long,kind:string,action:string>"
    place = {k: i for i, k in enumerate(KINDS)}

    def find(batches):
        for batch in batches:
            base, words = [], []
            for value, hashes, starts in _texts_with_words(batch.column("text")):
                own = base_spans(value)
                base.append([(a, place[k], b, k, "generalised") for a, b, k in own])
                hits = np.flatnonzero(held.value[hashes & np.uint64((1 << bits) - 1)] > 0)
                words.append(_word_places(value, hashes, starts, hits, own) if len(hits) else [])
            names = ["start", "place", "end", "kind", "action"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([[dict(zip(names, s)) for s in b] for b in base], pa.list_(pa.struct(list(zip(names, kinds))))),
                pa.array([[dict(zip(("term", "start", "end"), w)) for w in ws] for ws in words],
                         pa.list_(pa.struct([(n, pa.int64()) for n in ("term", "start", "end")])))],
                names=["doc_id", "base", "words"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = saved(rows.mapInArrow(
        find, f"doc_id long, base array<{span}>, words array<struct<term:long,start:long,end:long>>"), "spans")
    found = found.withColumn("row", F.monotonically_increasing_id())  # of a saved table, so it is the same each time
    hits = found.filter(F.size("words") > 0).select("row", F.inline("words")).join(small(acts), "term")
    action = F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")
    telling = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.lit(place["term"]).alias("place"), "end", F.lit("term").alias("kind"), action.alias("action")))).alias("telling"))
    empty = F.array().cast(f"array<{span}>")
    return found.join(telling, "row", "left").select("doc_id", "base", F.coalesce("telling", empty).alias("telling"))


def _word_places(text: str, hashes, starts, hits, own) -> list[tuple[int, int, int]]:
    """(hash, start, end) in code points of the words at `hits` that lie outside the entities."""
    data = np.frombuffer(text.encode(), np.uint8)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = np.concatenate([_TABLE[data] != 0, [False]])
    out = []
    for k in hits.tolist():
        end = int(starts[k])
        while inside[end]:
            end += 1
        a, b = int(points[starts[k]]), int(points[end])
        if not any(a < y and x < b for x, y, _ in own):
            out.append((int(hashes[k:k + 1].view(np.int64)[0]), a, b))
    return out


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the entities' spans, and all spans as text, for each row."""
    def text_of(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[n(k) for k in KINDS[:4]], F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text_of(F.array_sort(F.concat("base", "telling"))).alias("spans"), F.size("telling").cast("long").alias("n_terms"))


def sanitised(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """`text` with (start, end, kind, action) carried out: an entity becomes its kind, a term a mark or nothing."""
    out, at = [], 0
    for start, end, kind, action in sorted(found):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], "" if action == "removed" else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with `text` sanitised. Rows and their spans meet by id, so ids must be distinct here."""
    @F.udf("string")
    def apply(value, base, telling):
        every = [(s["start"], s["end"], s["kind"], s["action"]) for s in [*(base or []), *(telling or [])]]
        return None if value is None else sanitised(value, every)

    names = [fresh(docs, n) for n in ("span_id", "span_base", "span_telling")]
    joined = docs.join(found.select("doc_id", "base", "telling").toDF(*names), F.col(doc_id).eqNullSafe(F.col(names[0])), "left")
    return joined.withColumn(text, apply(text, *names[1:])).drop(*names)
