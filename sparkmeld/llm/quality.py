"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

A small network over byte-class n-gram frequencies and a few counts of a text is trained on trusted positives and
unlabelled texts: the risk of negatives is what the unlabelled risk leaves after the positives' share (the class
prior) is taken off, and steps that would push it below zero are reversed. The unlabelled texts are a sample of all
documents, labelled or not, and the class prior is estimated on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEGMENT, WORD, crc_mod, raw, slices, texts, word_hashes

BUCKETS = 1 << 10
EXTRA = 8
HIDDEN = 24
EPOCHS = 30
BATCH = 256
RATE = 0.004
#: Bound of the labelled rows that are fitted on.
MAX_TRAIN_ROWS = 6_000
#: Bound of the unlabelled texts that are fitted on, a sample of all rows by a hash of the key.
MAX_UNLABELLED_ROWS = 6_000
#: Class prior of the network that the prior is estimated with.
FIRST_PRIOR = 0.5
#: Share of the sample that is held back from training to estimate the prior and to place the cut.
HELD = 0.25
#: The estimate of the class prior fails (is too low) in about this share of samples.
DELTA = 0.1

#: Classes of bytes: letters by case, digits, spaces, line ends, bytes beyond ASCII; every other byte is its own class.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = 128


def _ngrams(text: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed pairs and triples of byte classes; a segment of a long text at a time."""
    got, pairs, last, carry = np.zeros(BUCKETS), 0, -1, np.array([10])
    for lo in range(0, len(text), SEGMENT):
        c = _CLASS[text[lo : lo + SEGMENT]]
        run = (c != np.concatenate(([last], c[:-1]))) | ((c != ord("a")) & (c != 128))  # runs of one class count once: a word is its shape, however long
        last = c[-1]
        c = np.concatenate((carry, c[run], [10] if lo + SEGMENT >= len(text) else []))
        c, k = c.astype(np.int64), len(carry)
        pair = c[k - 1 : -1] * 257 + c[k:]
        triple = c[max(k - 2, 0) : -2] * 66049 + c[max(k - 1, 1) : -1] * 257 + c[max(k, 2) :]
        got[: BUCKETS // 2] += np.bincount((pair * 2654435761 >> 7) % (BUCKETS // 2), minlength=BUCKETS // 2)
        got[BUCKETS // 2 :] += np.bincount((triple * 2654435761 >> 9) % (BUCKETS // 2), minlength=BUCKETS // 2)
        pairs += len(pair)
        carry = c[-2:]
    return np.sqrt(got / (pairs + 1)).astype(np.float32)


def features(arr: pa.Array) -> np.ndarray:
    """(texts, BUCKETS + EXTRA) float32: square roots of n-gram shares, then counts of a whole text, each about 0 to 1."""
    data, at = raw(arr)
    size = np.diff(at)
    out = np.zeros((len(arr), BUCKETS + EXTRA), np.float32)
    for i in range(len(arr)):  # a text at a time: the buckets of one stay in the cache
        if size[i]:
            out[i, :BUCKETS] = _ngrams(data[at[i] : at[i + 1]])
    words, n = word_hashes(data, at)
    ends = np.cumsum(n)
    for i in range(len(arr)):
        w = words[ends[i] - n[i] : ends[i]]
        x = out[i, BUCKETS:]
        x[0] = np.log1p(size[i]) / 12
        x[1] = np.log1p(n[i]) / 10
        if n[i]:
            x[2] = len(np.unique(w)) / n[i]
            x[3] = len(np.unique(w[:-1] * np.uint64(3) + w[1:])) / n[i]
            x[4] = min(WORD[data[at[i] : at[i + 1]]].sum() / n[i] / 20, 2)
        x[5] = size[i] == 0
        x[6] = 1
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float
    cut: float
    steepness: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.logits(x).astype(np.float64) - self.cut) * self.steepness, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_nnpu(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Model:
    """positive: trusted positives; unlabelled: the unlabelled texts, which a positive may be of. Loss: the sigmoid loss, minimised by Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = x[unlabelled].mean(0), 1 / (x[unlabelled].std(0) + 0.02)
    m = Model(mean, scale, (rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), 0.0, prior, 0.0, 1.0)
    z = ((x - mean) * scale).astype(np.float32)
    pos, others, params = np.flatnonzero(positive), np.flatnonzero(unlabelled), [m.w1, m.b1, m.w2, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(others)
        for k in range(0, len(order), BATCH):
            u, p = order[k : k + BATCH], rng.choice(pos, min(len(pos), BATCH))
            rows = np.concatenate((p, u))
            a = z[rows] @ m.w1 + m.b1
            h = np.maximum(a, 0)
            s = _sigmoid(h @ m.w2 + params[3][0])  # loss of a positive: 1 - s, of a negative: s
            ds = s * (1 - s)
            sp, su = s[: len(p)], s[len(p) :]
            negative = su.mean() - prior * sp.mean()
            g = np.zeros(len(rows), np.float32)
            if negative >= 0:
                g[: len(p)] = -2 * prior * ds[: len(p)] / len(p)
                g[len(p) :] = ds[len(p) :] / len(u)
            else:  # the step that raises the negatives' risk again
                g[: len(p)] = prior * ds[: len(p)] / len(p)
                g[len(p) :] = -ds[len(p) :] / len(u)
            ga = g[:, None] * m.w2[None, :] * (a > 0)
            grads = [z[rows].T @ ga + 1e-4 * m.w1, ga.sum(0), h.T @ g, np.array([g.sum()], np.float32)]
            step += 1
            for q, gr, v, w in zip(params, grads, first, second, strict=True):
                v[:] = 0.9 * v + 0.1 * gr
                w[:] = 0.999 * w + 0.001 * gr**2
                q -= RATE * (v / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.999**step)) + 1e-8)
    m.b2 = float(params[3][0])
    return m


def fit(train: DataFrame, rows: int = MAX_TRAIN_ROWS, unlabelled_rows: int = MAX_UNLABELLED_ROWS, seed: int = 3) -> Model:
    """train(key, text, label): 1 trusted positive, all else unlabelled.

    The unlabelled texts are a sample of all rows. The class prior is estimated on them: a first network is trained with
    a prior of FIRST_PRIOR and its scores of held-back rows give the prior of the
    second. Labels of 0 teach nothing: such rows are unlabelled texts like others. Held-back positives and unlabelled
    texts place the cut at score 0.5.
    """
    n_pos, n_all = train.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.lit(1))).first()
    bound = lambda n, most: (1 << 30) if n <= most else int(most / n * (1 << 30))
    u_bound, own_bound = bound(n_all, unlabelled_rows), bound(n_pos, rows)
    at = F.pmod(F.xxhash64("key", "text", F.lit("bounded sample")), F.lit(1 << 30))
    trusted = F.coalesce(F.col("label") == 1, F.lit(False))
    # the first condition needs no label, so that texts are drawn before they are joined to labels
    sample = train.where(at < max(u_bound, own_bound)).where((at < u_bound) | (trusted & (at < own_bound))).select("key", "text", trusted.alias("trusted"), (at < u_bound).alias("u"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(texts(part)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), part.column(3), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "trusted", "u", "x"])

    got = sorted(sample.mapInArrow(pack, "key string, trusted boolean, u boolean, x binary").collect(), key=lambda r: (r.key or "", r.x, r.trusted))
    width = BUCKETS + EXTRA
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32) if got else np.zeros((1, width), np.float32)
    positive = np.array([r.trusted for r in got] or [False])
    unlabelled = np.array([r.u for r in got] or [True])
    prior = FIRST_PRIOR
    if not positive.any():
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros((width, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), 1.0, prior, 0.0, 1.0)
    held = np.random.default_rng(seed).random(len(x)) < HELD
    if not all((own & part).any() for own in (positive, unlabelled) for part in (held, ~held)):
        held[:] = False
    m = train_nnpu(x[~held], positive[~held], unlabelled[~held], prior, seed)
    if held.any():
        z = m.logits(x[held])
        prior = _prior(z[positive[held]], z[unlabelled[held]])
        m = train_nnpu(x[~held], positive[~held], unlabelled[~held], prior, seed)
    own = held if held.any() else ~held
    z = m.logits(x[own])
    m.cut = _cut(z[positive[own]], z[unlabelled[own]], prior)
    return m


def _prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled scores: the least ratio of what both have above a score, where its bound is least."""
    at = np.unique(positive)
    above = lambda z: 1 - np.searchsorted(np.sort(z), at) / len(z)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / DELTA) / 2 / len(positive)) + np.sqrt(np.log(4 / DELTA) / 2 / len(unlabelled))
    i = int(((u + slack) / p).argmin())
    return float(min(max(u[i] / p[i], 0.02), 0.98))


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The middle of the widest cut at which the positive-unlabelled estimate of the error rate is least.

    The rate is prior * (positives below) + (unlabelled above) - prior * (positives above), the last two not below zero
    together: what of the unlabelled is above the cut and not accounted for by positives is wrongly accepted.
    """
    edges = np.unique(np.concatenate((positive, unlabelled)))
    edges = np.concatenate(([edges[0] - 1], edges, [edges[-1] + 1])) if len(edges) else np.array([-1.0, 1.0])
    middle = (edges[:-1] + edges[1:]) / 2
    below = lambda z: np.searchsorted(np.sort(z), middle) / max(len(z), 1)
    lost = below(positive)
    error = prior * lost + np.maximum(1 - below(unlabelled) - prior * (1 - lost), 0)
    width = np.where(error <= error.min() + 1e-9, np.diff(edges), -1)
    return float(middle[int(width.argmax())])


def score(spark: SparkSession, docs: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row; null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 21):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(features(texts(part))), pa.float64())], ["key", "score"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def good(spark: SparkSession, docs: DataFrame, model: Model, *, at: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `at` or more."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.scores(features(texts(part))) >= at))

    return docs.mapInArrow(run, docs.schema)


def training_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(key, text, label) of the docs that the fold leaves, without a label (null) where the labels of sf_dir have none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)")
    return docs.where(crc_mod("doc_id", 3) != 1).select("doc_id", "text").join(labels, "doc_id", "left").select(F.col("doc_id").alias("key"), "text", "label")


def score_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, score) of all docs, learned from those that the fold leaves and the labels of sf_dir."""
    return score(spark, docs.select("doc_id", "text"), fit(training_rows(spark, docs, sf_dir)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels are learned from the rows that are not held out.

    Null and empty texts score as a text without bytes. Without positives all scores are above 0.5. Repeated rows score
    alike; an empty table gives no rows.
    """
    out = score_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
