"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a run of `min_tile` words (a seed) are compared: the longest common run of words
that are not yet marked becomes a tile, its words are marked on both sides, and so on until no run of `min_tile` words is
left. Runs are found by running Karp-Rabin: hashes of windows of s words, for s from long to short, each hash read off a
running sum. An item is leaked by a document if tiles cover at least `coverage` of its words, in whatever order the
passages stand.

The seeds of a block of items are broadcast as sorted numbers; items come in blocks of bounded size, so a large test
set takes more passes over the documents, not more memory. Documents are not shuffled, and each is compared whole.

Words are lower-cased runs of letters and digits (ASCII marks and white space separate). Nulls and empty texts have no
words and match nothing; items with fewer than `min_tile` words must occur whole. Rows that repeat an id are judged one by
one and may report a pair twice; null ids are kept. Ties between runs go to the item's first words, then to the
document's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import without
from shoal.llm.words import byte_classes, gram_hashes, text_blocks, word_hashes

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_ITEMS = 20_000
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_BASE = 0xD6E8FEB86659FD93
_SCHEMA = "doc_id long, item_id long, coverage double, tiles long, longest long, covered_words long, item_words long"


def words_of(column) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    table = byte_classes(_MARKS)
    for _, _, data, offsets in text_blocks(pc.utf8_lower(column)):
        hashes, firsts, _ = word_hashes(data, offsets, table)
        for a, b in zip(firsts[:-1], firsts[1:]):
            yield hashes[a:b]


def window_hashes(words: np.ndarray, size: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words: differences of one running sum, brought to a common power."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[:len(words) - size + 1]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tile(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, words), longest first. A search length is halved once its runs are marked."""
    n = max(len(doc), len(item)) + 1
    powers = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    free_item, free_doc = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    while size >= min_tile:
        _mark_round(item, doc, free_item, free_doc, size, powers, tiles)
        size = 0 if size == min_tile else max(min_tile, size // 2)
    return tiles


def _free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that hold no marked word."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def _mark_round(item, doc, free_item, free_doc, size, powers, tiles) -> None:
    """Mark all runs of at least `size` words, longest first."""
    at_item, at_doc = _free_windows(free_item, size), _free_windows(free_doc, size)
    if not len(at_item) or not len(at_doc):
        return
    in_item = window_hashes(item, size, *powers)[at_item]
    in_doc = window_hashes(doc, size, *powers)[at_doc]
    hits = np.flatnonzero(np.isin(in_doc, in_item))
    places: dict[int, list[int]] = {}
    for k, h in enumerate(in_item.tolist()):
        places.setdefault(h, []).append(int(at_item[k]))
    runs: dict[tuple[int, int], int] = {}
    for k in hits.tolist():
        j = int(at_doc[k])
        for i in places[int(in_doc[k])]:
            runs[(i - j, j)] = i
    queue: list[tuple[int, int, int]] = []
    for (diagonal, j), i in runs.items():
        if (diagonal, j - 1) in runs or not np.array_equal(item[i:i + size], doc[j:j + size]):
            continue  # the middle of a longer run, which starts earlier, or equal hashes of different words
        n, most = size, min(len(item) - i, len(doc) - j)
        while n < most and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
            n += 1
        heapq.heappush(queue, (-n, i, j))
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        both = free_item[i:i + n] & free_doc[j:j + n]
        if both.all():
            free_item[i:i + n] = False
            free_doc[j:j + n] = False
            tiles.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], both.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(queue, (a - b, i + a, j + a))


class _Items:
    """A block of test items and the seeds that lead to them."""

    def __init__(self, ids: list, texts: list, min_tile: int):
        self.ids = ids
        self.words = list(words_of(pa.array(texts, pa.string())))
        self.min_tile = min_tile
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, words in enumerate(self.words):
            if len(words):
                size = min(min_tile, len(words))
                by_size.setdefault(size, []).append((np.unique(gram_hashes(words, size)), k))
        self.seeds = {}
        for size, found in by_size.items():
            hashes = np.concatenate([h for h, _ in found])
            owners = np.concatenate([np.full(len(h), k) for h, k in found])
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], owners[order]

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Items that share a seed with the document."""
        out = []
        for size, (hashes, owners) in self.seeds.items():
            grams = np.unique(gram_hashes(words, size))
            a, b = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            out += [owners[x:y] for x, y in zip(a[b > a], b[b > a])]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
          item_id: str = "item_id", min_tile: int = MIN_TILE, coverage: float = COVERAGE,
          block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and item it leaks: the share of the item's words that tiles cover, and the tiles' sizes."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = rows.count()
    blocks = max(1, -(-total // block_items))
    part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = block.collect()  # a block of the test set, of bounded size
        held = spark.sparkContext.broadcast(_Items([r.item_id for r in got], [r.text for r in got], min_tile))
        found = part.mapInArrow(_leak_finder(held, coverage), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _leak_finder(held, coverage: float):
    def find(batches):
        known = held.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for doc, words in zip(ids, words_of(batch.column("text"))):
                for k in known.candidates(words).tolist():
                    item = known.words[k]
                    tiles = tile(item, words, min(known.min_tile, len(item)))
                    covered = sum(n for _, _, n in tiles)
                    if covered >= coverage * len(item):
                        out.append((doc, known.ids[k], covered / len(item), len(tiles), max(n for _, _, n in tiles),
                                    covered, len(item)))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            names = ["doc_id", "item_id", "coverage", "tiles", "longest", "covered_words", "item_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return find


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that leak no item, all columns unchanged. Rows with the id of a leaking document go too."""
    return without(docs, doc_id, leaks(docs, items, text, doc_id, **options).select("doc_id"))
