"""Byte-level BPE as a finite-state transducer, and its streaming decoder.

A state of the transducer knows every place where a token may still begin: the bytes since that place, as a node of the
trie of tokens, and the last token before it. Reading a byte gives the one token that ends there (two tokens may stand side
by side only if the merges of their bytes give just these two). Tokens go out once the ways to all places of a state agree
on them, which is asked every `LOOKAHEAD` bytes. States and their transitions are made when first met and then kept,
so a byte costs one lookup; beyond `MAX_STATES` they are made anew.

Texts are cut into pieces, a block of them at a time, where the pattern always cuts: the usual one at marks, line breaks and
white space (`piece_starts`), any other at single spaces between other characters. The distinct pieces of a block are found by
Arrow, the outputs for pieces and for the words of those that hold several are kept, `MAX_WORDS` at a time. The limits bound
memory only; outputs do not depend on them.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.simple8b import KINDS, Kept, piece_starts
from shoal.llm.words import text_blocks

LOOKAHEAD = 1024
MAX_STATES = 150_000
MAX_PAIRS = 250_000
MAX_WORDS = 100_000
BLOCK_TOKENS = 8192
TEXT_BYTES = 2 << 20
USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def space_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of some texts: at each text, and before each space between two ASCII letters, digits or marks."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    kinds = KINDS[data]
    cut[1:n - 1] = (kinds[1:-1] == 1) & (kinds[:-2] > 3) & (kinds[2:] > 3)
    cut[offsets[1:] - 1] = False  # a space at the end of a text
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class _Memory:
    """What was kept, in two generations: at `limit` new entries the older generation goes, what is in use stays."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class _State(dict):
    """Places where a token may begin: the trie node of the bytes since then, and in the lower 32 bits the last token before it plus 1.

    Holds, for each byte met so far, the one token that ends with it and the state after it.
    """

    __slots__ = ("places", "step")

    def __init__(self, places: tuple, step):
        self.places, self.step = places, step

    def __missing__(self, byte: int) -> tuple:
        return self.step(self, byte)


class Transducer:
    """Tokens of one pretoken, read byte by byte. The compiled vocabulary: a trie of tokens, and how each is merged."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.grows = [-1], [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                below = self.child.get(key)
                if below is None:
                    below = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = below
            self.token_at[node] = rank
        self._ends: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}
        self.size = [len(self.token_bytes.get(i, b"")) for i in range(max(ranks.values(), default=-1) + 1)]
        self.depth = [0] * len(self.token_at)
        for key, below in self.child.items():  # a node comes after its parent
            self.depth[below] = self.depth[key >> 8] + 1
        self._reset()

    def _reset(self) -> None:
        self.start = _State((0,), self._step)
        self.states = {self.start.places: self.start}

    def merges(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The definition: merge the pair of lowest rank (under `below`), the first of equals, until none is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spines(self, token: int) -> tuple[bool, list, list]:
        """Whether its own bytes merge to the token; its last parts and its first parts while it is being merged.

        Each part comes with the rank of the merge that uses it up.
        """
        known = self._ends.get(token)
        if known is None:
            data, never = self.token_bytes[token], 1 << 60
            if len(data) == 1:
                known = True, [(data, never)], [(data, never)]
            else:
                parts = self.merges(data, token)
                if len(parts) != 2:
                    known = False, [], []
                else:
                    last, first = self._spines(parts[1])[1], self._spines(parts[0])[2]
                    known = True, [(data, never)] + [(x, min(r, token)) for x, r in last], \
                        [(data, never)] + [(x, min(r, token)) for x, r in first]
            self._ends[token] = known
        return known

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two stand side by side: no merge across their border comes before those that use up its sides.

        Of merges of equal rank the left one comes first.
        """
        if before < 0:
            return self._spines(token)[0]
        key = before << 32 | token
        known = self._pairs.get(key)
        if known is None:
            rank, whole = self.ranks.get, self._spines(token)
            known = whole[0]
            for x, used_x in self._spines(before)[1] if known else ():
                for y, used_y in whole[2]:
                    r = rank(x + y)
                    if r is not None and r < used_x and r <= used_y:
                        known = False
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _step(self, state: _State, byte: int) -> tuple[int, _State]:
        """The one token that ends with `byte`, and the state after it."""
        places, ended = [], -1
        child, token_at, grows, pairs = self.child, self.token_at, self.grows, self._pairs
        for place in state.places:
            node = child.get((place >> 32) << 8 | byte)
            if node is not None:
                token, before = token_at[node], (place & 0xFFFFFFFF) - 1
                if token >= 0 and ended < 0:
                    fits = pairs.get(before << 32 | token)
                    if fits or fits is None and self._fits(before, token):
                        ended = token
                if grows[node]:
                    places.append(node << 32 | (before + 1))
        places.append(ended + 1)
        key = tuple(places)
        following = self.states.get(key)
        if following is None:
            following = self.states[key] = _State(key, self.start.step)
        found = state[byte] = ended, following
        return found

    def _agreed(self, state: _State, ends: list[int]) -> int:
        """How far the ways to all places of `state` are the same."""
        at = {len(ends) - 1 - self.depth[place >> 32] for place in state.places}
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.size[ends[last]])
        return at.pop()

    def _way(self, ends: list[int], to: int) -> list[int]:
        out = []
        while to > 0:
            out.append(ends[to])
            to -= self.size[ends[to]]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        """Tokens of a pretoken. `ends` holds, for each byte since the last token that went out, the token ending there."""
        if len(self.states) > self.max_states:
            self._reset()
        state, ends, out = self.start, [-1], []
        append = ends.append
        for at in range(0, len(data), LOOKAHEAD):
            if at:
                sure = self._agreed(state, ends)
                out += self._way(ends, sure)
                del ends[1:sure + 1]
            for byte in data[at:at + LOOKAHEAD]:
                token, state = state[byte]
                append(token)
        if out:
            return out + self._way(ends, len(ends) - 1)
        return self._way(ends, len(ends) - 1)


class Encoder:
    """Token ids of whole texts, each match of `pattern` by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_words: int = MAX_WORDS):
        self.transducer = Transducer(ranks, max_states)
        self.pattern = regex.compile(pattern)
        self.starts = piece_starts if pattern == USUAL_PATTERN else space_starts
        self._words, self._pieces = _Memory(max_words), Kept(max_words)

    def _word(self, word: str) -> bytes:
        ids = self._words.get(word)
        if ids is None:
            ids = self._words.put(word, self._ids(word.encode("utf-8")))
        return ids

    def _ids(self, word: bytes) -> bytes:
        return array("I", self.transducer.encode(word)).tobytes()

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of new pieces; most are one word, which is kept as a piece only."""
        out = []
        for piece in pieces:
            words = self.pattern.findall(piece.decode("utf-8"))
            out.append(self._ids(piece) if len(words) == 1 else b"".join(map(self._word, words)))
        return out

    def blocks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, list[int]]]:
        """For runs of texts: their ids, where those of each text begin, with their end; their bytes, and the same for these."""
        for _, _, data, offsets in text_blocks(column, TEXT_BYTES):
            if not len(data):
                yield np.zeros(0, "<u4"), [0] * len(offsets), data, offsets.tolist()
                continue
            starts = self.starts(data, offsets)
            ids, ends = self._pieces.ids_of(data, starts, self._learn)
            yield ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)].tolist(), data, offsets.tolist()

    def encode(self, text: str) -> np.ndarray:
        return next(self.blocks(pa.array([text], pa.string())))[0]


class Utf8Machine:
    """UTF-8 read byte by byte. `need` counts the bytes that the open character still lacks."""

    def __init__(self):
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> None:
        for b in data:
            if self.need:
                if not self.low <= b <= self.high:
                    raise ValueError("a character breaks off")
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
            elif b >= 0x80:
                if 0xC2 <= b <= 0xDF:
                    self.need = 1
                elif 0xE0 <= b <= 0xEF:
                    self.need = 2
                    self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
                elif 0xF0 <= b <= 0xF4:
                    self.need = 3
                    self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
                else:
                    raise ValueError("no character begins like this")


class Decoder:
    """Bytes of a stream of ids, in pieces of whole characters: an open character waits for its other bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())
        self.digits = pa.array([b"%d " % i for i in range(len(table))], pa.large_binary())
        self.size = np.array([len(token) for token in table], dtype=np.int64)
        self.alone = np.array([_complete(token) for token in table], dtype=bool)

    def pieces(self, ids: np.ndarray, block: int = BLOCK_TOKENS):
        machine, held = Utf8Machine(), b""
        for at in range(0, len(ids), block):
            part = ids[at:at + block]
            # tokens that are whole characters leave a machine at rest where it is
            for token in self.table.take(pa.array(part[~self.alone[part]])).to_pylist():
                machine.feed(token)
            data, _ = _joined(self.table, part)
            data, held = held + data.tobytes(), b""
            if machine.need:
                cut = len(data) - 1
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
                data, held = data[:cut], data[cut:]
            yield data
        if machine.need:
            raise ValueError("the last character breaks off")


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of `table` for the ids, one after the other, and where each begins, with their end."""
    taken = table.take(pa.array(ids))
    data = taken.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    places = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1, taken.offset * 8) if len(ids) else np.zeros(1, np.int64)
    return data[places[0]:places[-1]], places - places[0]


def _complete(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


_workers: dict[str, tuple[Encoder, Decoder]] = {}


def _of_worker(held) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each worker process and vocabulary."""
    data, pattern, *limits = held.value
    key = hashlib.sha256(data + repr((pattern, limits)).encode()).hexdigest()
    if key not in _workers:
        _workers.clear()
        ranks = parse_ranks(data)
        _workers[key] = Encoder(ranks, pattern, *limits), Decoder(ranks)
    return _workers[key]


def encoded(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", doc_id: str = "doc_id",
            with_ids: bool = False, max_states: int = MAX_STATES, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and `ids` if asked for): each text encoded and decoded again.

    The limits say how many states and words a worker process keeps, so less time or less memory; the result is the same. The vocabulary file is read by the driver and sent to the executors. A null text is empty; ids of rows may be null
    or repeat; other columns are ignored. A text that comes back changed fails the job.
    """
    with open(rank_file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast((f.read(), pattern, max_states, max_words))
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        encoder, decoder = _of_worker(held)
        for batch in batches:
            counts, shas, decoded, lists = [], [], [], []
            for ids, places, data, offsets in encoder.blocks(batch.column("text")):
                decimals, at = _joined(decoder.digits, ids)
                at, back = at[places].tolist(), memoryview(b"".join(decoder.pieces(ids)))
                ends = np.concatenate([[0], np.cumsum(decoder.size[ids])])[places].tolist()
                for k, (a, b) in enumerate(zip(places[:-1], places[1:])):
                    counts.append(b - a)
                    shas.append(hashlib.sha256(decimals[at[k]:max(at[k], at[k + 1] - 1)]).hexdigest())
                    decoded.append(hashlib.sha256(back[ends[k]:ends[k + 1]]).hexdigest())
                    if decoded[-1] != hashlib.sha256(data[offsets[k]:offsets[k + 1]]).hexdigest():
                        raise ValueError("a text is not what its ids decode to")
                    if with_ids:
                        lists.append(ids[a:b].astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                       pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, fields)
