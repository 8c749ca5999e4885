"""Token ids in binary files of 64-bit words (Simple-8b).

A word holds a selector in its upper 4 bits and, below them, as many ids as the selector says, all of one width; the first
id is in the lowest bits. Selector 0 is the escape: the next word is one id as it is. Ids are packed in blocks of
`BLOCK_IDS`; no word crosses a block, so blocks decode independently.

A file (little-endian) holds the ids of consecutive documents, each closed by its end id:

    magic "S8B1" and a zero word in 4 bytes; numbers of documents, ids, words and blocks, 8 bytes each
    words; for each block its first word, 8 bytes each (its first id is its number times BLOCK_IDS)
    for each document its doc_id and its number of ids, 8 bytes each, and 1 byte that is 1 if the doc_id is null

Documents are in ascending doc_id order within and across files. Each file is written under a name of its own and then
renamed, so a task that runs again replaces it whole.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.scratch import saved, trim
from shoal.llm.words import text_blocks

BLOCK_IDS = 1 << 14
FILE_CHARS = 16 << 20
MAX_PIECES, PIECE_BYTES = 300_000, 64
TEXT_BYTES = 2 << 20
BATCH_ROWS = "1000"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MAGIC = b"S8B1\0\0\0\0"
# Fixed values of the format: ids in a word and bits of each, by selector; 0 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
_STEPS = np.maximum(COUNTS, 1).astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each id: those of its upper half if that is not zero, else of its lower half (exact as doubles)."""
    if not len(ids) or ids.max() < 1 << 24:
        return np.frexp(ids.astype(np.float32))[1]  # exact as floats
    upper = ids >> np.uint64(32)
    bits = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(upper > 0, np.frexp(upper.astype(np.float64))[1] + 32, bits) if upper.any() else bits


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of one block; each takes as many ids as fit. A last word may have room left, which holds zeros."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    # bits[k] is 0 beyond the last id, so that a word at the end may stay short
    bits = np.concatenate([_bits(ids).astype(np.uint8), np.zeros(int(COUNTS.max()), np.uint8)])
    widest, count = bits[:n], 1
    chosen = np.where(widest > 60, 0, len(COUNTS) - 1).astype(np.uint8)
    # from few wide ids to many narrow ones; what does not fit fewer ids does not fit more
    for selector in range(len(COUNTS) - 2, 0, -1):
        for k in range(count, int(COUNTS[selector])):
            widest = np.maximum(widest, bits[k:n + k])
        count = int(COUNTS[selector])
        fits = widest <= WIDTHS[selector]
        if not fits.any():
            break
        chosen[fits] = selector
    steps = _STEPS[chosen].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    picked = chosen[starts].astype(np.int64)
    inside = np.diff(starts, append=n)
    shifts = (np.arange(n) - np.repeat(starts, inside)) * np.repeat(WIDTHS[picked], inside)
    packed = np.bitwise_or.reduceat(ids << shifts.astype(np.uint64), starts)
    raw = picked == 0
    places = np.arange(len(starts)) + np.cumsum(raw) - raw
    words = np.zeros(len(starts) + int(raw.sum()), dtype=np.uint64)
    words[places] = np.where(raw, np.uint64(0), picked.astype(np.uint64) << np.uint64(60) | packed)
    words[places[raw] + 1] = packed[raw]
    # what lies beyond the last id of a word that is not full belongs to no id
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The `n` ids of one block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    escapes = np.flatnonzero(selectors == 0)
    if len(escapes):
        at = -1
        for k in escapes.tolist():  # a raw word may look like an escape
            if k > at:
                raw[k + 1] = True
                at = k + 1
    head = np.flatnonzero(~raw)
    selectors = selectors[head]
    counts = np.where(selectors == 0, 1, COUNTS[selectors])
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(starts[-1]), dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        here = selectors == selector
        if selector == 0:
            out[starts[:-1][here]] = words[head[here] + 1]
            continue
        width = int(WIDTHS[selector])
        shifts = np.arange(int(COUNTS[selector]), dtype=np.uint64) * np.uint64(width)
        ids = (words[head[here]][:, None] >> shifts) & np.uint64((1 << width) - 1)
        out[starts[:-1][here][:, None] + np.arange(int(COUNTS[selector]))] = ids
    return out[:n]


class FileBuilder:
    """The bytes of a file; ids are packed as soon as they fill a block."""

    def __init__(self):
        self.documents: list[tuple[int | None, int]] = []
        self.blocks: list[bytes] = []
        self.sizes: list[int] = []
        self.n_ids, self.held, self.waiting = 0, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK_IDS:
            self._pack(self.waiting // BLOCK_IDS * BLOCK_IDS)

    def _pack(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for at in range(0, upto, BLOCK_IDS):
            words = pack(ids[at:min(at + BLOCK_IDS, upto)])
            self.blocks.append(words.astype("<u8").tobytes())
            self.sizes.append(len(words))
        self.n_ids += upto
        self.held, self.waiting = [ids[upto:].copy()], len(ids) - upto

    def bytes(self) -> bytes:
        self._pack(self.waiting)
        firsts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype("<u8")
        table = np.zeros(len(self.documents), dtype=[("id", "<i8"), ("n", "<u8"), ("null", "u1")])
        table["id"] = [d or 0 for d, _ in self.documents]
        table["n"] = [n for _, n in self.documents]
        table["null"] = [d is None for d, _ in self.documents]
        head = _MAGIC + struct.pack("<4Q", len(self.documents), self.n_ids, sum(self.sizes), len(self.sizes))
        return b"".join([head, *self.blocks, firsts.tobytes(), table.tobytes()])


def read_file(data) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document in a file. A block is decoded when it is reached."""
    view = memoryview(data)
    if bytes(view[:8]) != _MAGIC:
        raise ValueError("not a file of packed ids")
    n_docs, n_ids, n_words, n_blocks = struct.unpack("<4Q", view[8:40])
    words = np.frombuffer(view, "<u8", n_words, 40)
    firsts = np.frombuffer(view, "<u8", n_blocks, 40 + 8 * n_words).tolist() + [n_words]
    table = np.frombuffer(view, [("id", "<i8"), ("n", "<u8"), ("null", "u1")], n_docs, 40 + 8 * (n_words + n_blocks))
    held, block = np.zeros(0, np.uint64), 0
    for doc_id, n, null in table.tolist():
        parts, have = [held], len(held)
        while have < n:
            parts.append(unpack(words[firsts[block]:firsts[block + 1]], min(BLOCK_IDS, n_ids - block * BLOCK_IDS)))
            have += len(parts[-1])
            block += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if null else doc_id), held[:n]
        held = held[n:]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _kinds() -> np.ndarray:
    """For each byte: 0 control, 1 space, 2 other white space, 3 part of a longer character, 4 letter or digit, 5 another mark, 6 apostrophe."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F], kinds[0x80:], kinds[0x20], kinds[0x09:0x0E] = 5, 3, 1, 2
    kinds[[b for b in range(128) if chr(b).isalnum()]], kinds[ord("'")] = 4, 6
    return kinds


def _borders() -> np.ndarray:
    """By the kinds of two bytes side by side: 1 if two pieces always meet there, 2 and 3 if the character that ends must be looked at."""
    table = np.zeros((8, 8), np.uint8)
    table[4:7, 1:3] = 1  # white space after what is none
    table[4, 5:7] = table[5, 4] = 1  # an apostrophe may go with the letters after it
    table[3, 1:3], table[3, 5:7] = 2, 3
    return table.ravel()


KINDS, _BORDERS = _kinds(), _borders()


def _blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the character that ends with the bytes a, b and c is or once was white space."""
    return ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))
            | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
            | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            | (a == 0xE3) & (b == 0x80) & (c == 0x80))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of some texts: at each text, before white space that follows something else, between
    letters or digits and marks, and after a single line break or tab.

    The usual pattern of byte-level vocabularies cuts at all these places, whatever stands around them. Where a look at three
    bytes cannot tell, nothing is cut, which costs time only.
    """
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    kinds = KINDS[data]
    borders = _BORDERS[kinds[:-1] << 3 | kinds[1:]]
    cut[1:n] = borders == 1
    at = np.flatnonzero(borders > 1) + 1
    if len(at):
        a, b, c = data[np.maximum(at - 3, 0)], data[np.maximum(at - 2, 0)], data[at - 1]
        latin = (b == 0xC3) & (c != 0x97) & (c != 0xB7)
        cut[at[np.where(borders[at - 1] == 2, ~_blank(a, b, c), latin)]] = True
    cut[offsets] = True
    lone = np.flatnonzero(kinds[:-1] == 2)
    lone = lone[cut[lone] & (kinds[lone + 1] > 3)]
    cut[lone + 1] = True
    return np.flatnonzero(cut[:n])


class Kept:
    """Pieces and their ids, as flat columns. Once `limit` pieces have been asked for since the last time, the others go.

    So they do, and long pieces with them, once all take more than `PIECE_BYTES` times `limit` bytes.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self._set(pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, dtype=bool))

    def _set(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> None:
        self.pieces, self.ids, self.sizes, self.asked = pieces, ids, sizes, asked
        self.firsts = np.cumsum(sizes) - sizes

    def places(self, pieces: pa.Array, learn) -> np.ndarray:
        """The place of each of some distinct pieces; the ids of those that are not kept yet are asked of `learn`."""
        places = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().copy()
        new = places < 0
        if new.any():
            unknown = pieces.filter(pa.array(new))
            found = learn(unknown.to_numpy(zero_copy_only=False).tolist())
            places[new] = np.arange(len(found)) + len(self.pieces)
            self._set(pa.concat_arrays([self.pieces, unknown]), np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")]),
                      np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found)) >> 2]),
                      np.concatenate([self.asked, np.ones(len(found), dtype=bool)]))
        self.asked[places] = True
        return places

    def ids_of(self, data: np.ndarray, starts: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that begin at `starts`, and where those of each piece end."""
        bounds = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        number = self.places(coded.dictionary, learn)[coded.indices.to_numpy()]
        n = self.sizes[number]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.firsts[number] - (ends - n), n) + np.arange(int(ends[-1]))]
        self.shrink()
        return ids, ends

    def shrink(self) -> None:
        if np.count_nonzero(self.asked) >= self.limit or self.pieces.nbytes + self.ids.nbytes > PIECE_BYTES * self.limit:
            stay = self.asked & (pc.binary_length(self.pieces).to_numpy() <= PIECE_BYTES)
            self._set(self.pieces.filter(pa.array(stay)), self.ids[np.repeat(stay, self.sizes)], self.sizes[stay],
                      np.zeros(np.count_nonzero(stay), dtype=bool))


class _Tokens:
    """Ids of texts by the tokenizers library.

    Texts are cut into pieces where byte-level vocabularies always cut (`piece_starts`). The ids of pieces are kept; the new ones
    of a block of texts are encoded together, those that are one run of letters straight by the library's model, which is
    what its pre-tokenizer would hand on. A text that holds an added token (such as one that marks the end of a text) goes to
    the library whole, which gives that token its own id, and so does any text if the definition does not cut as said.
    """

    def __init__(self, definition: str, max_pieces: int = MAX_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.letters = _byte_letters()
        self.kept = Kept(max_pieces)
        splits = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.cuts = (splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
                     and not self.tokenizer.normalizer and not self.tokenizer.truncation and not self.tokenizer.padding)
        probe = [" the", "The", "été", " Größe", " 日本", "x"]
        self.direct = self._straight(probe) == self._fully(probe)

    def _fully(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _straight(self, pieces: list[str]) -> list[bytes]:
        split, model = self.letters[10], self.tokenizer.model
        spelt = "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split(split) if pieces else []
        return [array("I", [t.id for t in model.tokenize(s)]).tobytes() for s in spelt]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in pieces]
        runs, others = [], []
        for k, s in enumerate(texts):
            (runs if self.direct and s.removeprefix(" ").isalpha() else others).append(k)
        found = [b""] * len(texts)
        for numbers, encode in ((runs, self._straight), (others, self._fully)):
            for k, ids in zip(numbers, encode([texts[k] for k in numbers])):
                found[k] = ids
        return found

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of the column."""
        for _, _, data, offsets in text_blocks(column, TEXT_BYTES):
            whole, n = [], len(offsets) - 1
            raw = data.tobytes() if not self.cuts or self.added else b""
            if not self.cuts or any(a in raw for a in self.added):
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                whole = [k for k, t in enumerate(texts) if not self.cuts or any(a in t for a in self.added)]
                given = dict(zip(whole, self._fully([texts[k].decode() for k in whole])))
            ids, places = self._pieced(data, offsets) if len(whole) < n else (None, [0] * (n + 1))
            for k in range(n):
                yield np.frombuffer(given[k], "<u4") if whole and k in given else ids[places[k]:places[k + 1]]

    def _pieced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of a block of texts, and where those of each text begin, with their end."""
        if not len(data):
            return np.zeros(0, "<u4"), [0] * len(offsets)
        starts = piece_starts(data, offsets)
        ids, ends = self.kept.ids_of(data, starts, self._learn)
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)].tolist()


_workers: dict[int, _Tokens] = {}


def _of_worker(definition: str) -> _Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(definition)
    if key not in _workers:
        _workers.clear()
        _workers[key] = _Tokens(definition)
    return _workers[key]


def write_ids(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, text: str = "text",
              doc_id: str = "doc_id", file_chars: int = FILE_CHARS) -> DataFrame:
    """Encode the texts and write files to `folder` (a URI all executors reach); returns (file, path, n_docs, n_ids).

    Texts are range-partitioned by doc_id, a file to a partition of about `file_chars` characters. Null texts are empty and
    hold the end id alone; null doc_ids come first, and rows that repeat a doc_id each have their ids, side by side.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    parts = max(1, -(-chars // file_chars), min(spark.sparkContext.defaultParallelism, chars // (1 << 20)))
    ordered = rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        tokens, file, end = _of_worker(held.value), FileBuilder(), np.array([end_id], "<u4")
        for batch in batches:
            for d, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text"))):
                file.add(d, np.concatenate([ids, end]))
        number, n_docs, data = TaskContext.get().partitionId(), len(file.documents), file.bytes()
        n_ids = file.n_ids
        path = _write(folder, f"ids-{number:08d}.s8b", data)
        del file, data
        trim()  # the worker may stand idle while others take its place
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([number], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()),
            "n_ids": pa.array([n_ids], pa.int64())})

    rows_at_once = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, BATCH_ROWS)
    try:
        return saved(ordered.mapInArrow(run, "file long, path string, n_docs long, n_ids long"), "ids-files")
    finally:
        spark.conf.set(_ARROW_ROWS, rows_at_once)


def _write(folder: str, name: str, data: bytes) -> str:
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    part = posixpath.join(root, f".{name}-{uuid.uuid4().hex}")
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, posixpath.join(root, name))
    return posixpath.join(folder, name)


def read_ids(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and `ids` if asked for) of each document, read from the files.

    `start` counts the ids of all documents before it: those of earlier files, a sum over one number per file, and
    those before it in its own.
    """
    known = sorted((r.file, r.n_ids) for r in files.select("file", "n_ids").collect())  # one row per file
    before, total = {}, 0
    for number, n in known:
        before[number] = total
        total += n
    folder = files.select("path").first()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if folder is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(before)
    loaded = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.s8b").load(posixpath.dirname(folder.path))

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                start = held.value[int(path.rpartition("ids-")[2].removesuffix(".s8b"))]
                rows, lists = [], []
                for doc, ids in read_file(data.as_buffer()):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if with_ids:
                        lists.append(ids.astype(np.int64))
                columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(lists, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return loaded.select("path", "content").mapInArrow(run, schema)
