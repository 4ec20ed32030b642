"""Toxicity from subword bags.

A word is the average of the embeddings of its character n-grams and of itself, a text the average
of its words, and a linear softmax on that average gives the score. Embeddings and softmax are
trained jointly, in numpy, on a bounded sample of labelled rows. Misspellings share most n-grams with
the words they come from, so they are scored although no label ever named them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rowtrail.llm.common import batches, mix64, named, texts, with_fields

BUCKETS, DIM = 1 << 16, 4
SHORTEST, LONGEST = 3, 5
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_"
CACHE = 200_000
SLICE = 200  # texts whose new words are learnt together
RARE = 3  # words of fewer documents would be learnt by heart
STEPS, RATE, DAMPING, SCALE = 50, 0.1, 3.0, 40.0


@dataclass
class Model:
    """``embeddings`` by bucket, ``weights`` of both labels, ``bias`` of both labels."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def slopes(self) -> np.ndarray:
        """What each bucket adds to the difference of the two logits."""
        return SCALE * (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]))

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(STRIP))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words`` between word marks, and where each word's begin.

    Each word's code points are hashed in place, for all words at once.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    whole = np.add.reduceat(mix64(codes * np.uint64(0x9E3779B97F4A7C15) + (at - (ends - np.repeat(sizes, sizes))).astype(np.uint64)), np.cumsum(sizes) - sizes)
    found, owners = [mix64(whole)], [np.arange(len(words))]
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        rolled[: len(codes) - n + 1] = mix64(rolled[: len(codes) - n + 1] * np.uint64(31) + codes[n - 1 :] + np.uint64(n << 32))
        if n >= SHORTEST:
            inside = at + n <= ends
            found.append(rolled[inside])
            owners.append(owner[inside])
    bucket, owner = np.concatenate(found) % np.uint64(BUCKETS), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def fit(documents: list[str], labels: np.ndarray, prior: float, seed: int = 1) -> Model:
    """Joint training by Adam on all documents at once; ``prior`` is the share of label 1 to expect.

    One document in five is only watched: the weights of the step that scores it best are kept.
    """
    rng = np.random.default_rng(seed)
    bags = [Counter(words_of(text)) for text in documents]
    held = Counter(w for bag in bags for w in bag)
    number = {w: i for i, w in enumerate(w for w, n in held.items() if n >= RARE)}
    cells, kept = [], []
    for i, bag in enumerate(bags):
        own = [(number[w], n / bag.total()) for w, n in bag.items() if w in number]
        if own:
            kept.append(i)
            cells.append((np.array([w for w, _ in own]), np.array([n for _, n in own], np.float32)))
    labels = np.asarray(labels)[kept].astype(np.int64)
    if not len(labels) or labels.min() == labels.max():
        return fit_nothing(prior)
    sizes = np.array([len(c[0]) for c in cells])
    doc, word = np.repeat(np.arange(len(cells)), sizes), np.concatenate([c[0] for c in cells])
    share = np.concatenate([c[1] for c in cells]) * np.float32(SCALE)
    first = np.cumsum(sizes) - sizes
    bucket, begin = grams(list(number))
    per_word = np.diff(np.append(begin, len(bucket)))
    each = per_word.astype(np.float32)
    used, bucket = np.unique(bucket, return_inverse=True)
    by_word = np.argsort(word, kind="stable")
    word_first = np.searchsorted(word[by_word], np.arange(len(number)))
    by_bucket = np.argsort(bucket, kind="stable")
    bucket_first = np.searchsorted(bucket[by_bucket], np.arange(len(used)))
    bucket_word = np.repeat(np.arange(len(number)), per_word)[by_bucket]
    word_doc, word_share = doc[by_word], share[by_word]

    watched = np.arange(len(labels)) % 5 == 0
    rate = np.bincount(labels, minlength=2) / len(labels)
    weight = np.where(labels == 1, prior / rate[1], (1 - prior) / rate[0])
    inner = (np.where(watched, 0, weight) / weight[~watched].sum()).astype(np.float32)
    state = [x.astype(np.float32) for x in (rng.normal(0, 0.05, (DIM, len(used))), rng.normal(0, 0.5, (DIM, 2)), np.array([0.0, _logit(prior)]))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    best, best_loss = None, np.inf
    for step in range(1, STEPS + 1):
        e, w, b = state
        # One dimension at a time: sums over long plain arrays.
        means = np.stack([np.add.reduceat((np.add.reduceat(x[bucket], begin) / each)[word] * share, first) for x in e], axis=1)
        centre = means.mean(0)  # what all texts share is the bias's part
        means -= centre
        logits = means @ w + b
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)) * weight
        if (now := loss[watched].mean()) < best_loss:
            best, best_loss = [e.copy(), w.copy(), b - centre @ w], now
        d = p.copy()
        d[np.arange(len(labels)), labels] -= 1
        d *= inner[:, None]
        d_e = np.stack([np.add.reduceat((np.add.reduceat(x[word_doc] * word_share, word_first) / each)[bucket_word], bucket_first) for x in w @ (d - d.mean(0)).T])
        for x, grad, (m, v) in zip(state, (d_e, means.T @ d, d.sum(0)), moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            # Entries of small gradients, those of rare n-grams, take small steps.
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + DAMPING * np.sqrt((grad * grad).mean()) + 1e-12)
    e = np.zeros((BUCKETS, DIM), np.float32)
    e[used] = best[0].T
    return Model(e, best[1].astype(np.float32), best[2])


def fit_nothing(prior: float) -> Model:
    """The model whose every score is ``prior``."""
    return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.array([0.0, _logit(prior)]))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def train(
    df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000
) -> Model:
    """Fit on the labelled rows of ``df``: at most ``per_class`` rows of label 1 and twice
    as many of label 0, by hash of the id.

    An id with several labels has the highest; null labels and ids teach nothing, and rows that repeat
    an id count once. Training runs in one task, whose input this bound limits. Without rows of both
    labels every score is the share of label 1.
    """
    known = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter("y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for y in (0, 1):
        own = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class if y else 2 * per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most three times ``per_class`` ids.
    sample = texts(df, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def run(it):
        rows = {}
        for batch in it:
            for i, y, text in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "text")), strict=True):
                rows[i] = min(rows.get(i, (text, y)), (text, y))
        order = sorted(rows)
        model = fit([rows[i][0] for i in order], np.array([rows[i][1] for i in order], np.int64), prior)
        parts = [pa.array([p.astype("<f4").tobytes()], pa.binary()) for p in (model.embeddings, model.weights, model.bias)]
        yield pa.RecordBatch.from_arrays(parts, ["e", "w", "b"])

    row = sample.coalesce(1).mapInArrow(run, "e binary, w binary, b binary").first()
    if row is None:  # no partition at all
        return fit_nothing(prior)
    got = lambda x, *shape: np.frombuffer(x, "<f4").reshape(shape)
    return Model(got(row["e"], BUCKETS, DIM), got(row["w"], DIM, 2), got(row["b"], 2))


class WordSums(dict):
    """What each word adds to the difference of the logits; unknown words are computed on first use."""

    def __init__(self, slopes: np.ndarray):
        super().__init__()
        self.slopes = slopes

    def learn(self, words: set[str]) -> None:
        new = list(words - self.keys())
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        if new:
            bucket, begin = grams(new)
            total = np.add.reduceat(self.slopes[bucket], begin) / np.diff(np.append(begin, len(bucket)))
            self.update(zip(new, total.tolist(), strict=True))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1, from the whole text alone.

    A null, empty or blank text has the score of the bias. Ids may be null or repeat.
    """
    rows = texts(df, id_col, text_col)
    schema = with_fields(rows, score=T.DoubleType())
    # One number per bucket, whatever the data.
    slopes, offset = df.sparkSession.sparkContext.broadcast(model.slopes()), model.offset()

    def run(it):
        known = WordSums(slopes.value)

        def scores(texts: list[str]) -> list[float]:
            rows = [words_of(text) for text in texts]
            known.learn(set().union(*rows))  # new words of many texts at once
            at = np.array([offset + (sum(map(known.__getitem__, words)) / len(words) if words else 0.0) for words in rows])
            return (1 / (1 + np.exp(-np.clip(at, -500, 500)))).tolist()

        def make(batch: pa.RecordBatch) -> dict:
            text = batch.column("text")
            return {"id": batch.column("id"), "score": [x for lo in range(0, len(text), SLICE) for x in scores(text[lo : lo + SLICE].to_pylist())]}

        yield from batches(make, schema)(it)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
