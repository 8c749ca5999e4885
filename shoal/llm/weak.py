"""Toxicity by weak supervision.

1. Words, word beginnings and word ends that toxic documents hold more often than others are mined from a bounded
   sample of labelled rows and dealt into lexicons.
2. Every document gets the votes of many voters: one for each lexicon, and patterns (a fixed list of insults, insults after "you",
   words with marks put inside, shouting, piled-up exclamation marks).
3. A generative model of the votes is fitted by expectation-maximisation to the counts of vote patterns over all documents: a
   hidden label, each voter's accuracy under it, and the correlations between voters as a tree of pairwise dependencies, found anew
   in each round from the votes themselves. Documents with a known label count as that label.
4. A logistic regression on the mined features learns the model's posterior labels, on the sample; it scores all documents.

What is counted over the corpus are vote patterns, at most 2**voters of them. Rows shuffled hold votes and feature
numbers, never texts. A null or empty text has no features and gets the score of the bias alone. Without labelled rows the fixed
insults decide. Ids may be null or repeat: a row of the result to each row. Where labels repeat an id, the highest counts. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import saved, share, without

SAMPLE_ROWS = 20_000
FEATURES = 1500
MIN_SUPPORT = 5
LEXICONS = 9
KNOWN_WEIGHT = 3.0
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
# Insults that need no mining.
INSULTS = frozenset("""arsehole asshole bastard bitch clown coward creep cretin crybaby degenerate dimwit disgusting dumb dumbass
fool freak garbage idiot idiotic imbecile jerk liar loser lowlife maggot moron moronic parasite pathetic pig rat rubbish scum
scumbag sleazy slob stupid subhuman trash twat ugly vermin vile weasel wimp worthless""".split())
_AT_YOU = re.compile(r"\byou(?:'re| are| were)? (?:a |an |such a |just |all |so )?(?:" + "|".join(sorted(INSULTS)) + r")\b")
_MARKED = re.compile(r"\b[^\W\d_]+[*@$#!][^\W\d_*@$#!]+")
_PILED = re.compile(r"!{3,}|\?!")
PATTERNS = 5


def word_features(words: set[str]) -> set[str]:
    """A document's words, and their beginnings and ends of 3 to 5 letters, each with its kind before it."""
    out = {"w" + w for w in words}
    for n in (3, 4, 5):
        out.update(["<" + w[:n] for w in words if len(w) >= n])
    out.update([">" + w[-4:] for w in words if len(w) >= 4])
    return out


@dataclass
class Mined:
    """Chosen features by kind, with their numbers, and the lexicon of each (-1: in none)."""

    names: list[str]
    lexicon: list[int]
    by_kind: dict[tuple[str, int], dict[str, int]] = field(default_factory=dict)

    def __post_init__(self):
        for k, name in enumerate(self.names):
            kind = name[0]
            self.by_kind.setdefault((kind, 0 if kind == "w" else len(name) - 1), {})[name[1:]] = k

    def found(self, words: set[str]) -> list[int]:
        out = []
        for (kind, n), known in self.by_kind.items():
            have = words if kind == "w" else {w[:n] for w in words} if kind == "<" else {w[-n:] for w in words}
            out += [known[x] for x in have & known.keys()]
        return sorted(out)


def _sample(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, label) of a sample of about `rows` labelled rows, fixed by the ids; equal texts once."""
    total = known.count()
    part = known.filter(share(F.col("doc_id")) < (rows / total if total else 0.0))
    joined = docs.join(F.broadcast(part), "doc_id")  # bounded by `rows`
    return saved(joined.filter(F.length("text") > 0).dropDuplicates(["text"]), "labelled")


def _counts(sample: DataFrame, wanted: frozenset | None, least: int) -> dict[str, int]:
    """In how many of the sample's documents each feature occurs."""
    held = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            total: dict[str, int] = {}
            only = held.value
            for text in batch.column("text").to_pylist():
                features = word_features(set(_WORD.findall(text.lower())))
                for f in features if only is None else features & only:
                    total[f] = total.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["name", "n"])

    summed = sample.select("text").mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return {r.name: r.n for r in summed.filter(F.col("n") >= least).toLocalIterator()}


def mine(sample: DataFrame, features: int = FEATURES, least: int = MIN_SUPPORT) -> Mined:
    """Features that speak for toxicity, by their log-likelihood ratio. All counts are of the bounded sample."""
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        names = sorted("w" + w for w in INSULTS)
        return Mined(names, [0] * len(names))
    with_toxic = _counts(sample.filter("label = 1"), None, least)
    with_clean = _counts(sample.filter("label = 0"), frozenset(with_toxic), 1)
    scored = []
    for name, a in with_toxic.items():
        b = with_clean.get(name, 0)
        if a / toxic > 2 * (b + 0.5) / clean:
            p, q, r = a / toxic, (b + 0.5) / (clean + 1), (a + b) / (toxic + clean)
            gain = sum(n * math.log(x / r) + (m - n) * math.log((1 - x) / (1 - r))
                       for n, m, x in ((a, toxic, min(p, 1 - 1e-9)), (b, clean, q)) if 0 < r < 1)
            # the lower end of the share of toxic documents among those that hold it
            n, share_toxic = a + b, a / (a + b)
            low = (share_toxic + 2 / n - 2 * math.sqrt(share_toxic * (1 - share_toxic) / n + 1 / (n * n))) / (1 + 4 / n)
            scored.append((-gain, name, low))
    scored = sorted(scored)[:features]
    kinds = {"w": 0, "<": 1, ">": 2}
    lexicon, turn = [], {}
    for _, name, low in scored:
        if low >= 0.5:
            k = kinds[name[0]]
            turn[k] = turn.get(k, -1) + 1
            lexicon.append(k * 3 + turn[k] % 3)
        else:
            lexicon.append(-1)
    return Mined([name for _, name, _ in scored], lexicon)


def votes(text: str, words: set[str], found: list[int], mined: Mined) -> int:
    """A bit for each voter: first the lexicons, then the patterns."""
    out = 0
    for k in found:
        if mined.lexicon[k] >= 0:
            out |= 1 << mined.lexicon[k]
    lower = text.lower()
    letters = sum(map(str.isalpha, text))
    patterns = (bool(words & INSULTS), "you" in words and bool(_AT_YOU.search(lower)), bool(_MARKED.search(text)),
                letters > 20 and sum(map(str.isupper, text)) > letters / 2, bool(_PILED.search(text)))
    for k, fires in enumerate(patterns):
        out |= fires << (LEXICONS + k)
    return out


def observed(docs: DataFrame, mined: Mined) -> DataFrame:
    """(doc_id, held_out, votes, words, found) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(mined)

    def run(batches):
        known = held.value
        for batch in batches:
            masks, sizes, lists = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                words = set(_WORD.findall(text.lower()))
                found = known.found(words)
                masks.append(votes(text, words, found, known))
                sizes.append(len(words))
                lists.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(masks, pa.int32()), pa.array(sizes, pa.int32()),
                 pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "held_out", "votes", "words", "found"])

    return saved(docs.mapInArrow(run, "doc_id long, held_out boolean, votes int, words int, found array<int>"), "votes")


class LabelModel:
    """A hidden label and a tree of voters: each vote depends on the label and on one other vote."""

    def __init__(self, voters: int):
        self.voters, self.order = voters, [(k, -1) for k in range(voters)]
        self.prior = 0.1
        self.tables: dict[int, np.ndarray] = {}

    @staticmethod
    def _bits(patterns: np.ndarray, voters: int) -> np.ndarray:
        return (patterns[:, None] >> np.arange(voters)) & 1

    def fit(self, patterns: np.ndarray, known: np.ndarray, counts: np.ndarray, rounds: int = 30) -> "LabelModel":
        """`known` holds each pattern's label, -1 where it is hidden."""
        bits = self._bits(patterns, self.voters)
        weight = counts * np.where(known >= 0, KNOWN_WEIGHT, 1.0)
        labelled = known >= 0
        if labelled.any():
            belief = np.where(labelled, known, 0.0)
            self._maximise(bits, weight * labelled, belief)
        else:
            self._maximise(bits, weight, np.clip(bits.sum(axis=1) / 3.0, 0.02, 0.98))
        for _ in range(rounds):
            belief = np.where(labelled, known, self.posterior(patterns))
            self.order = self._tree(bits, weight, belief)
            self._maximise(bits, weight, belief)
        return self

    def _maximise(self, bits, weight, belief) -> None:
        mass = np.stack([weight * (1 - belief), weight * belief])
        self.prior = float((mass[1].sum() + 1) / (mass.sum() + 2))
        self.tables = {}
        for k, parent in self.order:
            table = np.zeros((2, 2, 2))  # label, vote of the parent, vote
            above = bits[:, parent] if parent >= 0 else np.zeros(len(bits), dtype=int)
            for y in (0, 1):
                np.add.at(table[y], (above, bits[:, k]), mass[y])
            alone = table.sum(axis=1, keepdims=True) + np.array([1.0, 0.1])
            alone /= alone.sum(axis=2, keepdims=True)
            table += 5.0 * alone  # rare combinations lean on the vote's own rate
            self.tables[k] = table / table.sum(axis=2, keepdims=True)

    def _tree(self, bits, weight, belief) -> list[tuple[int, int]]:
        """The tree of strongest dependencies given the label: mutual information in each label, the heaviest edges first."""
        gain = np.zeros((self.voters, self.voters))
        for mass in (weight * (1 - belief), weight * belief):
            total = mass.sum() + 1e-9
            both = (bits * mass[:, None]).T @ bits / total
            one = (bits * mass[:, None]).sum(axis=0) / total
            for a in (0, 1):
                for b in (0, 1):
                    p = np.where(a, one, 1 - one)[:, None] * np.where(b, one, 1 - one)[None, :]
                    j = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                    j = np.maximum(j, 1e-12)
                    gain += total * j * np.log(j / np.maximum(p, 1e-12))
        order, left = [(0, -1)], set(range(1, self.voters))
        while left:
            k, parent = max(((k, p) for k in left for p, _ in order), key=lambda e: (gain[e[0], e[1]], -e[0], -e[1]))
            order.append((k, parent))
            left.remove(k)
        return order

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = self._bits(patterns, self.voters)
        odds = np.full(len(bits), math.log(self.prior / (1 - self.prior)))
        for k, parent in self.order:
            above = bits[:, parent] if parent >= 0 else np.zeros(len(bits), dtype=int)
            odds += np.log(self.tables[k][1, above, bits[:, k]] / self.tables[k][0, above, bits[:, k]])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def logistic(rows: list[list[int]], words: np.ndarray, target: np.ndarray, features: int, rounds: int = 400,
             decay: float = 2e-4) -> np.ndarray:
    """Weights of the features, of the log of the words, and the bias: accelerated gradient descent on the whole sample."""
    length = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows]) if length.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), length)
    size = np.log1p(words) / 10
    w, last = np.zeros(features + 2), np.zeros(features + 2)
    step = 4.0 / (1.0 + length.mean() + 1e-9)
    for t in range(rounds):
        v = w + (t / (t + 3)) * (w - last)
        z = np.bincount(owner, v[flat], len(rows)) + v[-2] * size + v[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        slope = np.concatenate([np.bincount(flat, error[owner], features), [error @ size, error.sum()]])
        slope[:-1] += decay * v[:-1] / 10
        w, last = v - step * slope, w
    return w


def scored(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, text: str = "text", doc_id: str = "doc_id",
           label: str = "toxic", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, posterior) of each row of `docs`; labels of held-out rows are not looked at."""
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), flag.alias("held_out"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    learnt = rows.select("doc_id", "held_out").filter("not held_out and doc_id is not null").distinct()
    known = saved(known.join(learnt, "doc_id").select("doc_id", "label"), "known")
    sample = _sample(rows.select("doc_id", "text"), known, sample_rows)
    mined = mine(sample)
    seen = observed(rows, mined)

    patterns = seen.join(known, "doc_id", "left").groupBy("votes", F.coalesce("label", F.lit(-1)).alias("label")).count().toPandas()
    model = LabelModel(LEXICONS + PATTERNS)
    spark = docs.sparkSession
    if len(patterns):
        model.fit(*(patterns[c].to_numpy() for c in ("votes", "label", "count")))
        train = seen.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").select("votes", "words", "found")
        train = train.orderBy("votes", "words", F.xxhash64("found")).collect()  # at most the sample
    else:
        train = []
    if train:
        target = model.posterior(np.array([r.votes for r in train]))
        weights = logistic([r.found for r in train], np.array([r.words for r in train]), target, len(mined.names))
    else:
        weights = np.array([4.0] * len(mined.names) + [0.0, -3.0])
    masks = patterns["votes"].unique() if len(patterns) else np.zeros(0, np.int64)
    beliefs = dict(zip(masks.tolist(), model.posterior(masks).tolist())) if len(masks) else {}
    held = spark.sparkContext.broadcast((weights, beliefs))

    def run(batches):
        w, belief = held.value
        for batch in batches:
            found = batch.column("found")
            starts = found.offsets.to_numpy()
            total = np.concatenate([[0.0], np.cumsum(w[found.values.to_numpy(zero_copy_only=False)])])
            z = total[starts[1:]] - total[starts[:-1]] + w[-2] * np.log1p(batch.column("words").to_numpy()) / 10 + w[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                 pa.array([belief[v] for v in batch.column("votes").to_pylist()], pa.float64())],
                names=["doc_id", "held_out", "score", "predicted", "posterior"])

    return seen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, posterior double")


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, all columns unchanged. Decisions meet the rows by id."""
    toxic = scored(docs, labels, **options).filter("predicted = 1").select("doc_id")
    return without(docs, options.get("doc_id", "doc_id"), toxic)
