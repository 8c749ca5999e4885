"""The most frequent word n-grams of a table, counted level by level.

An n-gram is at most as frequent as the two (n-1)-grams it is made of. So level n counts only n-grams whose two parts can still be
among the most frequent, and the count they must reach grows with every level. What is counted and shuffled are 64-bit hashes; rows hold their words,
never their n-grams: blocks of rows keep each distinct word once, and where it stands in a byte or a few. Strings are made for the survivors alone. Which parts survived is shipped as bitmaps of a
measured size, which may let too many through but none too few. Of n-grams tied at the last count, the first ones by string are taken.

Tasks work on up to `WORDS_AT_ONCE` words at a time (or one longer row), however many rows Spark hands them at once. Where n-grams occur is kept
as one list to a row, as bytes. What is no longer read is deleted, and shuffle files go with the job that wrote them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import bytes_column, bytes_lists, steps, unstepped, values
from shoal.session import computed_once, dropped, shuffles_dropped, stored

MAX_BITS = 27
FLUSH = 1 << 20
WORDS_AT_ONCE = 1 << 18
BLOCK_WORDS = 1 << 20
TASKS_A_CORE = 3
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


@dataclass
class Vocabulary:
    """`terms(code, term, total, df)` from the most frequent on, and their occurrences: `packed(id, codes, counts)`, a row to a row that has any.

    Both are int arrays as bytes, the codes as steps from one to the next.
    """

    terms: DataFrame
    packed: DataFrame
    rows: int

    @property
    def cells(self) -> DataFrame:
        """(id, cells(code, tf))"""
        return unpacked_cells(self.packed)

    @property
    def counts(self) -> DataFrame:
        """(id, code, tf)"""
        return self.cells.select("id", F.inline("cells"))


def unpacked_cells(packed: DataFrame) -> DataFrame:
    """(id, cells(code, tf)) of `packed(id, codes, counts)`; cells are in order of code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes = bytes_lists(batch.column("codes"), np.int32)
            counts = bytes_lists(batch.column("counts"), np.int32)[1]
            cells = pa.StructArray.from_arrays([pa.array(unstepped(offsets, codes)), pa.array(counts.astype(np.int64))], names=["code", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cells)], names=["id", "cells"])

    return packed.select("id", "codes", "counts").mapInArrow(run, f"id {_id_type(packed)}, cells array<struct<code:int,tf:bigint>>")


def _id_type(rows: DataFrame) -> str:
    kind = rows.schema["ids"].dataType.elementType if "ids" in rows.columns else rows.schema["id"].dataType
    return kind.simpleString()


def _hashes() -> list:
    return [F.expr(f"transform(words, w -> xxhash64({s}, w))").alias(f"h{s}") for s in (1, 2)]


def hashed_words(rows: DataFrame, words) -> DataFrame:
    """(id, words, h1, h2): the words of each row with two hashes each, kept for several passes."""
    found = computed_once(rows.select("id", *[c for c in rows.columns if c != "id"]), words=words)
    return stored(found.select("id", "words", *_hashes()), "words")


def packed_words(rows: DataFrame, words) -> DataFrame:
    """(ids, lengths, places, words): blocks of rows with their distinct words, kept for several passes.

    A block has up to BLOCK_WORDS words, or one longer row. Its words are ordered by their count, so places are small numbers; they are kept
    byte by byte, the lowest of all first, which compresses best.
    """
    found = computed_once(rows.select("id", *[c for c in rows.columns if c != "id"]), words=words).select("id", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "words", BLOCK_WORDS):
            column = batch.column("words")
            lengths = np.diff(column.offsets.to_numpy()).astype(np.int32)
            coded = column.flatten().dictionary_encode()
            place, names = values(coded.indices), coded.dictionary
            order = np.argsort(-np.bincount(place, minlength=len(names)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            width = max(1, (len(order).bit_length() + 7) // 8)
            planes = rank[place].view(np.uint8).reshape(-1, 4)[:, :width].T
            one = pa.array([0, len(names)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")), pa.array([lengths.tobytes()]),
                 pa.array([planes.tobytes()]), pa.ListArray.from_arrays(one, names.take(pa.array(order)))], names=["ids", "lengths", "places", "words"])

    return stored(found.mapInArrow(run, f"ids array<{_id_type(found)}>, lengths binary, places binary, words array<string>"), "words")


def _columns(words: DataFrame, *names: str) -> DataFrame:
    """Columns of `hashed_words`, or what `_rows` makes them of in the blocks of `packed_words`."""
    if "places" not in words.columns:
        return words.select(*names)
    return words.select("lengths", "places", *["ids" if c == "id" else F.col(c) if c == "words" else _hashes()[int(c[1]) - 1] for c in names])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks, one batch to a block; rows that come as such pass."""
    for batch in batches:
        if "places" not in batch.schema.names:
            yield batch
            continue
        for i in range(batch.num_rows):
            lengths = np.frombuffer(batch.column("lengths")[i].as_py(), np.int32)
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            planes = np.frombuffer(batch.column("places")[i].as_py(), np.uint8).reshape(-1, max(1, offsets[-1]))
            place = np.zeros((offsets[-1], 4), np.uint8)
            if len(place):
                place[:, :len(planes)] = planes.T
            place = place.reshape(-1).view("<u4").astype(np.int32)
            found = {}
            for c in ("words", "h1", "h2"):
                if c in batch.schema.names:
                    own = batch.column(c)[i].values
                    flat = pa.DictionaryArray.from_arrays(pa.array(place), own) if c == "words" else pa.array(values(own).astype(np.int64)[place])
                    found[c] = pa.ListArray.from_arrays(pa.array(offsets), flat)
            if "ids" in batch.schema.names:
                found["id"] = batch.column("ids")[i].values
            yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))


def _pieces(batches: Iterator[pa.RecordBatch], column: str = "h1", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, up to WORDS_AT_ONCE words (or `most`) at a time."""
    most = most or WORDS_AT_ONCE
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of `g`, ascending, and the sums of their `n`."""
    if len(g) == 0:
        return g, n
    order = np.argsort(g)
    g, n = g[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(n, first)


class _Text:
    """The words of a batch end to end; `levels` gives the hashes of the n-grams that begin at each word."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        column = batch.column("h1")
        self.lengths = np.diff(column.offsets.to_numpy())
        self.left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(self.lengths.sum())
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        salt = np.uint64(seed) * _ODD[3]
        lanes = [c for c in ("h1", "h2") if c in batch.schema.names]  # counting needs the first alone
        self.words = [self._mixed(values(batch.column(c).flatten()).astype(np.int64).view(np.uint64) ^ salt) for c in lanes]

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * _ODD[1]
        x = (x ^ (x >> np.uint64(27))) * _ODD[2]
        return x ^ (x >> np.uint64(31))

    def levels(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, first hash, second hash, whether an n-gram begins here); past the end of a row the hashes mean nothing."""
        g = [w.copy() for w in self.words]
        for n in range(1, high + 1):
            if n > 1:
                whole = max(0, len(self.left) - n + 1)
                for lane, w in zip(g, self.words):
                    lane[:whole] = self._mixed(lane[:whole] * _ODD[0] + w[len(w) - whole:] + np.uint64(n))
            if n >= low:
                yield n, g[0], g[-1], self.left >= n


class _Bitmap:
    """A set of hashes as bits, `size` a power of two; has all of them and, by chance, a few more."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.mask = bits, np.uint64(size - 1)

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> "_Bitmap":
        """Bits are joined on the executors; the words of the bitmap that reach the driver are bounded by MAX_BITS."""
        size = 1 << min(MAX_BITS, max(10, (16 * n).bit_length()))
        at = F.col("g").bitwiseAND(F.lit(size - 1))
        bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(g & 31 AS INT))")
        table = hashes.select(F.shiftright(at, 5).cast("int").alias("word"), bit.alias("bit"))
        found = table.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(size >> 5, np.uint32)
        bits[values(found.column("word"))] = values(found.column("bits")).astype(np.uint32)
        return cls(bits, size)

    @classmethod
    def here(cls, g: np.ndarray) -> "_Bitmap":
        """Of hashes at hand."""
        size = 1 << min(MAX_BITS, max(10, (16 * len(g)).bit_length()))
        at = (g & np.uint64(size - 1)).astype(np.int64)
        bits = np.zeros(size >> 5, np.uint32)
        np.bitwise_or.at(bits, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        return cls(bits, size)

    def has(self, g: np.ndarray) -> np.ndarray:
        at = g & self.mask
        return (self.bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def _survived(places: np.ndarray, kept: _Bitmap | None, g: np.ndarray) -> np.ndarray:
    return places if kept is None else places & kept.has(g)


def _alive(text: _Text, kept: list[_Bitmap | None], high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level, the hashes and the places where an n-gram begins whose parts have all survived so far."""
    before = None
    for n, g, g2, begins in text.levels(1, high):
        open_places = begins if before is None else begins & before & np.append(before[1:], False)
        yield n, g, g2, open_places
        if n <= len(kept):
            before = _survived(open_places, kept[n - 1], g)


def _tally(batches: Iterator[pa.RecordBatch], kept: list[_Bitmap | None], level: int, seed: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed():
        return _summed(*(np.concatenate(c) for c in zip(*held)))

    for batch in _pieces(_rows(batches)):
        for n, g, _, places in _alive(_Text(batch, seed), kept, level):
            if n == level:
                found, counts = np.unique(g[places], return_counts=True)
                held.append((found, counts))
                size += len(found)
        if size > FLUSH:
            found, counts = summed()
            if len(found) > FLUSH // 2:
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["g", "total"])
                held, size = [], 0
            else:
                held, size = [(found, counts)], len(found)
    if held:
        found, counts = summed()
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["g", "total"])


def _threshold(histogram: dict[int, int], terms: int) -> tuple[int, int]:
    """The count that the last of the `terms` most frequent has (1 if there are fewer), and how many are above it."""
    above = 0
    for total in sorted(histogram, reverse=True):
        if total == 1 or above + histogram[total] >= terms:
            return total, above
        above += histogram[total]
    return 1, above


def most_frequent(words: DataFrame, low: int, high: int, terms: int, seed: int = 0) -> Vocabulary:
    """The `terms` most frequent n-grams, low <= n <= high, of `words` (see `packed_words`, `hashed_words`); ties go to the first string.

    n-grams with a digest in common (128 bits) would show in counts that do not add up; another seed is taken then.
    """
    spark = words.sparkSession
    rows = words.agg(F.sum(F.size("ids"))).first()[0] or 0 if "ids" in words.columns else words.count()
    counts, kept, least, histogram, levels = None, [], 1, Counter(), []
    for n in range(1, high + 1):
        shipped = spark.sparkContext.broadcast(list(kept))
        partial = _columns(words, "h1").mapInArrow(lambda b, s=shipped, n=n: _tally(b, s.value, n, seed), "g long, total long")
        found = stored(partial.groupBy("g").agg(F.sum("total").alias("total")).filter(F.col("total") >= least).withColumn("n", F.lit(n)), "grams")
        levels.append(found)
        own = {r["total"]: r["n"] for r in found.groupBy("total").agg(F.count("*").alias("n")).collect()}  # a row to a count
        if n >= low:
            counts = found if counts is None else counts.unionByName(found)
            histogram.update(own)
            least = max(least, _threshold(histogram, terms)[0])
        # While nothing is ruled out there is no need to ask.
        kept.append(None if least == 1 else _Bitmap.of(found.filter(F.col("total") >= least).select("g"), sum(c for t, c in own.items() if t >= least)))
    least, above = _threshold(histogram, terms)
    counts = counts.filter(F.col("total") >= least)
    strings = _strings(words, counts, kept, least, low, high, terms, above, seed)
    with shuffles_dropped(spark):
        code = strings.orderBy(F.col("total").desc(), "term").limit(terms).toArrow()  # bounded by `terms`
    dropped(*levels)
    table = {c: code.column(c).to_pylist() for c in ("term", "total")} | {c: values(code.column(c)) for c in ("g", "g2", "n")}
    occurrences = stored(_occurrences(words, table, low, high, seed), "occurrences")
    with shuffles_dropped(spark):
        per_term = occurrences.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism).mapInArrow(_per_code, "code int, tf long, n long").groupBy("code").agg(F.sum("tf").alias("found"), F.sum("n").alias("df")).toArrow()  # bounded by `terms`
    at = np.argsort(values(per_term.column("code")))
    found, total = values(per_term.column("found"))[at], np.array(table["total"], np.int64)
    if len(found) != len(total) or (found != total).any():
        dropped(occurrences)
        return most_frequent(words, low, high, terms, seed + 1)
    vocabulary = pa.table({"code": pa.array(range(len(total)), pa.int32()), "term": pa.array(table["term"], pa.string()), "total": total,
                           "df": values(per_term.column("df"))[at].astype(np.int64)})
    return Vocabulary(spark.createDataFrame(vocabulary), occurrences, rows)


def _strings(words: DataFrame, counts: DataFrame, kept: list[_Bitmap | None], least: int, low: int, high: int, terms: int, above: int, seed: int) -> DataFrame:
    """(g, g2, n, term, total) of the n-grams above the last count, and of enough of those tied at it."""
    spark = words.sparkSession
    sure = counts.filter(F.col("total") > least).select("g").toArrow()  # fewer than `terms`
    shipped = spark.sparkContext.broadcast((np.sort(values(sure.column("g")).astype(np.int64)), kept))
    room = terms - above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        certain, maps = shipped.value
        seen, tied = np.zeros(0, np.int64), {}
        for batch in _pieces(_rows(batches)):
            text, out, flat = _Text(batch, seed), [], None
            for n, g, g2, places in _alive(text, maps, high):
                if n < low:
                    continue
                at = np.flatnonzero(_survived(places, maps[n - 1], g))
                found, first = np.unique(g[at].view(np.int64), return_index=True)
                place = np.searchsorted(seen, found)
                new = np.ones(len(found), bool)
                inside = place < len(seen)
                new[inside] = seen[place[inside]] != found[inside]
                if not new.any():
                    continue
                seen = np.insert(seen, place[new], found[new])  # stays ascending
                found, at = found[new], at[first[new]]
                flat = flat if flat is not None else batch.column("words").flatten()
                columns = [flat.take(pa.array(at + k)).to_pylist() for k in range(n)]
                is_sure = np.isin(found, certain, assume_unique=True)
                for k, (own, whole) in enumerate(zip(g2[at].view(np.int64).tolist(), zip(*columns))):
                    row = (int(found[k]), own, n, " ".join(whole))
                    if is_sure[k] or least > 1:
                        out.append(row)
                    else:  # each n-gram at all is tied, so a task needs to hand on no more than there is room for
                        tied[row[3], n] = row
            if len(tied) > 4 * room + 100_000:
                tied = dict(sorted(tied.items())[:room])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["g", "g2", "n", "term"])
        last = [row for _, row in sorted(tied.items())[:room]]
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*last)], names=["g", "g2", "n", "term"])

    # Each task hands on what it meets once, so there are a few for each core, however large the input.
    few = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    found = _columns(words, "words", "h1", "h2").coalesce(few).mapInArrow(run, "g long, g2 long, n long, term string")
    found = found.groupBy("g", "n").agg(F.min(F.struct("term", "g2")).alias("t")).select("g", "n", "t.term", "t.g2")
    return found.join(counts, ["g", "n"])


def _occurrences(words: DataFrame, table: dict, low: int, high: int, seed: int) -> DataFrame:
    """(id, codes, counts) of the terms in `table`, whose place is their code; rows without any are left out, codes ascend (see `Vocabulary`)."""
    order = np.argsort(table["g"], kind="stable")
    shipped = words.sparkSession.sparkContext.broadcast((table["g"][order], table["g2"][order], table["n"][order], order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_of, g2_of, n_of, code_of = shipped.value
        maybe = _Bitmap.here(g_of.view(np.uint64))
        for batch in _pieces(_rows(batches)):
            if len(g_of) == 0:
                continue
            text, rows, codes = _Text(batch, seed), [], []
            for n, g, g2, begins in text.levels(low, high):
                at = np.flatnonzero(begins & maybe.has(g))
                place = np.minimum(np.searchsorted(g_of, g[at].view(np.int64)), len(g_of) - 1)
                hit = (g_of[place] == g[at].view(np.int64)) & (g2_of[place] == g2[at].view(np.int64)) & (n_of[place] == n)
                rows.append(text.row[at[hit]])
                codes.append(code_of[place[hit]])
            key = np.concatenate(rows).astype(np.int64) * len(g_of) + np.concatenate(codes)
            found, tf = np.unique(key, return_counts=True)
            if len(found) == 0:
                continue
            row, first = np.unique(found // len(g_of), return_index=True)
            offsets = np.append(first, len(found))
            codes = steps(offsets, (found % len(g_of)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), bytes_column(offsets, codes), bytes_column(offsets, tf.astype(np.int32))], names=["id", "codes", "counts"])

    return _columns(words, "id", "h1", "h2").mapInArrow(run, f"id {_id_type(words)}, codes binary, counts binary")


def _per_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, tf, n): how often each term occurs in the rows of a task, and in how many."""
    total, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        offsets, codes = bytes_lists(batch.column("codes"), np.int32)
        codes, counts = unstepped(offsets, codes), bytes_lists(batch.column("counts"), np.int32)[1]
        width = max(len(total), int(codes.max(initial=-1)) + 1)
        total, rows = (np.pad(x, (0, width - len(x))) for x in (total, rows))
        total += np.bincount(codes, weights=counts, minlength=width).astype(np.int64)
        rows += np.bincount(codes, minlength=width)
    found = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found]), pa.array(rows[found])], names=["code", "tf", "n"])
