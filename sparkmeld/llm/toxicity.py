"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of one for the word and one for its first bytes; words too rare in the sample have none, so
unseen words of a long text look like those that were trained on. Filters of several widths slide over the whole text, max pooling keeps each filter's strongest answer, and a logistic
layer scores it; a score is a function of its own text alone. A naive Bayes guess of the language, from the same hashed words, picks the threshold that was
calibrated for that language; the score is shifted so that every threshold lies at 0.5. LEAST_TEXTS and NEGATIVES only
shape what is fitted; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, raw, slices, texts, word_hashes

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Bytes of a word's beginning, and bits of its bucket.
PREFIX, PREFIX_BITS = 5, 14
#: Texts of the sample that a word or beginning must be in to get a vector.
LEAST_TEXTS = 4
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 4
BATCH = 48
RATE = 0.01
#: Bounds, on average, of the labelled sample that is fitted on: rows, and characters of them all. The share of rows that
#: meets both is drawn whatever their length.
MAX_TRAIN_ROWS = 16_000
MAX_TRAIN_CHARS = 200_000_000
#: Rows of label 0 that are kept for each of label 1.
NEGATIVES = 3
#: Share of the sample that thresholds are calibrated on.
CALIBRATION = 0.3
#: A language with fewer calibration rows of either kind takes the threshold of all languages.
LEAST_ROWS = 20


def word_buckets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of every text (low bits: the word's, high bits: its beginning's), and the words of each text."""
    words, heads, n = word_hashes(*raw(pc.utf8_lower(arr)), prefix=PREFIX)
    return ((words >> np.uint64(64 - BUCKET_BITS)) | (heads >> np.uint64(64 - PREFIX_BITS) << np.uint64(BUCKET_BITS))).astype(np.int32), n


#: Words that filters start at in one step, so that a step's work stays in the cache; longer texts go in pieces.
STEP = 16384


def _pieces(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first word, number of words) of pieces of texts, in groups of about STEP words; texts without words have none."""
    per = -(-n // STEP)
    text = np.repeat(np.arange(len(n)), per)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    count = np.minimum(n[text] - first, STEP)
    group = (np.cumsum(count) - count) // STEP
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if hi > lo:
            yield text[lo:hi], first[lo:hi], count[lo:hi]


def _windows(start: np.ndarray, count: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(starts, widest filter): places of the words under a filter at each start of each piece; -1 beyond the text's end."""
    places = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    out = places[:, None] + np.arange(max(WIDTHS))
    out[out >= np.repeat(end, count)[:, None]] = -1
    return out


@dataclass
class Model:
    embed: np.ndarray  # (1 + known words and beginnings, DIM); row 0 is zero
    word_row: np.ndarray  # row of each word bucket, 0: none
    head_row: np.ndarray
    filters: list[np.ndarray]  # by width: (width * DIM, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    languages: np.ndarray  # (BUCKETS, L) log probabilities
    prior: np.ndarray
    threshold: np.ndarray  # by language, of the logit
    steepness: float

    def pooled(self, ids: np.ndarray, n: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(texts, filters): each filter's strongest answer at a word of the text, before bias (-inf in a text without words).

        A window that hangs over the text's end sees nothing there, so an answer depends on its own text only. With
        `places` also where in ids the strongest (the first of equals) begins.
        """
        begin = np.cumsum(n) - n
        best = np.full((len(n), FILTERS * len(WIDTHS)), -np.inf)
        at = np.zeros(best.shape, np.int64) if places else None
        x = self.embed.astype(np.float64)
        filters = [k.astype(np.float64) for k in self.filters]
        for text, first, count in _pieces(n):
            start = begin[text] + first
            seen = _windows(start, count, begin[text] + n[text])
            words = ids[seen[:, 0]]
            more = np.where(seen >= 0, ids[seen], -1)
            wide = (x[np.where(more < 0, 0, self.word_row[more & (BUCKETS - 1)])] + x[np.where(more < 0, 0, self.head_row[(more >> BUCKET_BITS) & ((1 << PREFIX_BITS) - 1)])]).reshape(len(words), -1)
            cuts = np.cumsum(count) - count
            for i, (w, k) in enumerate(zip(WIDTHS, filters, strict=True)):
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                conv = wide[:, : w * DIM] @ k
                top = np.maximum.reduceat(conv, cuts, axis=0)
                for j, t in enumerate(text) if places else ():
                    where = start[j] + conv[cuts[j] : cuts[j] + count[j]].argmax(0)
                    at[t, own] = np.where(top[j] > best[t, own], where, at[t, own])
                    best[t, own] = np.maximum(best[t, own], top[j])
                if not places:
                    np.maximum.at(best[:, own], text, top)
        return best, at

    def features(self, best: np.ndarray) -> np.ndarray:
        bias = np.concatenate(self.bias).astype(np.float64)
        return np.maximum(np.where(np.isfinite(best), best, 0) + bias, 0)

    def logits(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of every text; one without words pools nothing but the filters' bias."""
        return (self.features(self.pooled(ids, n)[0]) * self.weight).sum(1) + self.offset

    def language(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.tile(self.prior, (len(n), 1)).astype(np.float64)
        full = np.flatnonzero(n > 0)
        if len(full) and self.languages.shape[1] > 1:
            total[full] += np.add.reduceat(self.languages[ids & (BUCKETS - 1)].astype(np.float64), (np.cumsum(n) - n)[full], axis=0)
        return total.argmax(1)

    def scores(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (self.logits(ids, n) - self.threshold[self.language(ids, n)]) * self.steepness
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(m: Model, docs: list[np.ndarray], y: np.ndarray, seed: int = 5) -> None:
    """Logistic loss by Adam; only the winning position of each filter in each text has a gradient."""
    rng = np.random.default_rng(seed)
    params = [m.embed, *m.filters, *m.bias, m.weight]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            n = np.array([len(docs[i]) for i in pick])
            ids = np.concatenate([docs[i] for i in pick])
            best, at = m.pooled(ids, n, places=True)
            feats = m.features(best)
            p = 1 / (1 + np.exp(-np.clip(feats @ m.weight + m.offset, -30, 30)))
            g = (p - y[pick]) / len(pick)
            grads = [np.zeros(x.shape) for x in params]
            grads[-1][:] = feats.T @ g
            m.offset -= RATE * float(g.sum())
            gf = g[:, None] * m.weight[None, :] * (feats > 0)
            end = np.cumsum(n)
            touched = [np.zeros(1, np.int64)]
            for i, w in enumerate(WIDTHS):
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                gw = gf[:, own]
                grads[1 + len(WIDTHS) + i][:] = gw.sum(0)
                for j in range(w):
                    place = at[:, own] + j
                    word = np.where(place < end[:, None], ids[np.minimum(place, len(ids) - 1)], -1)
                    rows = np.where(word < 0, 0, m.word_row[word & (BUCKETS - 1)]), np.where(word < 0, 0, m.head_row[(word >> BUCKET_BITS) & ((1 << PREFIX_BITS) - 1)])
                    grads[1 + i][j * DIM : (j + 1) * DIM] = np.einsum("bf,bfd->df", gw, m.embed[rows[0]] + m.embed[rows[1]])
                    back = (gw[:, :, None] * m.filters[i][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM)
                    for r in rows:
                        np.add.at(grads[0], r.ravel(), back)
                        touched.append(r.ravel())
            step += 1
            moved = np.unique(np.concatenate(touched))
            for q, (x, gr, a, b) in enumerate(zip(params, grads, first, second, strict=True)):
                rows = moved if q == 0 else slice(None)
                a[rows] = 0.9 * a[rows] + 0.1 * gr[rows]
                b[rows] = 0.999 * b[rows] + 0.001 * gr[rows] ** 2
                x[rows] -= RATE * (a[rows] / (1 - 0.9**step)) / (np.sqrt(b[rows] / (1 - 0.999**step)) + 1e-8)
            m.embed[0] = 0


def _best_cut(z: np.ndarray, y: np.ndarray, negative: float) -> float:
    """The middle of the widest cut with the fewest errors, each on a label of 0 counted `negative` times; between the kinds if there is only one."""
    if not len(z) or y.min() == y.max():
        return 0.0
    o = np.argsort(z, kind="stable")
    z, y = z[o], y[o]
    wrong = negative * np.sum(y == 0) + np.concatenate(([0.0], np.cumsum(np.where(y == 1, 1.0, -negative))))
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    width = np.diff(edges)
    width[wrong > wrong.min() + 1e-9] = -1
    i = int(width.argmax())
    return float((edges[i] + edges[i + 1]) / 2)


def fit(train: DataFrame, rows: int = MAX_TRAIN_ROWS, seed: int = 5) -> Model:
    """train(key, text, label 0/1, lang or null, chars: the text's length). Null texts are empty; rows with another or a null label teach nothing.

    The length comes as a column so that rows are counted, and joined to labels for it, without their texts.
    """
    labelled = train.where("label in (0, 1)")
    n_all, n_pos, chars = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    sample = bounded_sample(labelled, min(rows, MAX_TRAIN_CHARS * n_all // max(chars, 1)), n_all)
    share = min(1.0, NEGATIVES * n_pos / max(n_all - n_pos, 1)) if n_pos else 1.0
    sample = sample.where((F.col("label") == 1) | (F.pmod(F.xxhash64("key", "text", F.lit("negatives")), F.lit(1 << 30)) < int(share * (1 << 30)))) if n_pos else sample

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, n = word_buckets(texts(part))
                ends = np.cumsum(n)
                keep = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_pydict({
                    "key": part.column(0).take(pa.array(keep)).cast(pa.string()),
                    "ids": pa.array([ids[ends[i] - n[i] : ends[i]].tobytes() for i in keep], pa.binary()),
                    "label": part.column(2).take(pa.array(keep)).cast(pa.int32()),
                    "lang": part.column(3).take(pa.array(keep)).cast(pa.string()),
                })

    got = sorted(sample.select("key", "text", "label", "lang").mapInArrow(pack, "key string, ids binary, label int, lang string").collect(), key=lambda r: (r.key, r.ids))
    docs = [np.frombuffer(r.ids, np.int32) for r in got]
    y = np.array([r.label for r in got], np.int64)
    names = sorted({r.lang for r in got if r.lang is not None}) or ["und"]
    counts, n_docs = np.full((BUCKETS, len(names)), 0.1), np.ones(len(names))
    for r, ids in zip(got, docs, strict=True):
        if r.lang is not None:
            counts[:, names.index(r.lang)] += np.bincount(ids & (BUCKETS - 1), minlength=BUCKETS)
            n_docs[names.index(r.lang)] += 1
    log_p = np.log(counts / counts.sum(0)).astype(np.float32)
    rng = np.random.default_rng(seed)
    held = rng.random(len(docs)) < CALIBRATION
    in_texts = np.zeros(BUCKETS, np.int64), np.zeros(1 << PREFIX_BITS, np.int64)
    for ids, h in zip(docs, held, strict=True):
        if not h:
            in_texts[0][np.unique(ids & (BUCKETS - 1))] += 1
            in_texts[1][np.unique(ids >> BUCKET_BITS)] += 1
    known = [x >= LEAST_TEXTS for x in in_texts]
    n_rows = 1 + sum(int(x.sum()) for x in known)
    m = Model(
        embed=(rng.standard_normal((n_rows, DIM)) * 0.05).astype(np.float32),
        word_row=np.where(known[0], np.cumsum(known[0]), 0).astype(np.int32),
        head_row=np.where(known[1], np.cumsum(known[1]) + known[0].sum(), 0).astype(np.int32),
        filters=[(rng.standard_normal((w * DIM, FILTERS)) * (1.5 / np.sqrt(w * DIM))).astype(np.float32) for w in WIDTHS],
        bias=[np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        weight=(rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32),
        offset=0.0, languages=log_p, prior=np.log(n_docs / n_docs.sum()), threshold=np.zeros(len(names)), steepness=1.0,
    )
    m.embed[0] = 0
    negative = 1 / share
    if not len(docs) or y.min() == y.max():
        m.offset, m.weight[:] = (-2.0 if not len(docs) or y.max() == 0 else 2.0), 0
        return m
    _train(m, [d for d, h in zip(docs, held, strict=True) if not h], y[~held], seed)
    if held.any():
        n = np.array([len(d) for d, h in zip(docs, held, strict=True) if h])
        ids = np.concatenate([d for d, h in zip(docs, held, strict=True) if h])
        z, lang, t = m.logits(ids, n), m.language(ids, n), y[held]
        overall = _best_cut(z, t, negative)
        for i in range(len(names)):
            own = lang == i
            m.threshold[i] = _best_cut(z[own], t[own], negative) if min((t[own] == 1).sum(), (t[own] == 0).sum()) >= LEAST_ROWS else overall
    return m


def score(spark: SparkSession, docs: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row; null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(*word_buckets(texts(part))), pa.float64())], ["key", "score"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels are learned from the rows that are not held out.

    Null and empty texts get the score of a text without words. Without labels of both kinds all scores are below 0.5
    (above it if all labels are 1). Repeated rows score alike; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    train = docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang", F.length("text").alias("chars")).join(labels, "doc_id").select(F.col("doc_id").alias("key"), "text", "label", "lang", "chars")
    out = score(spark, docs.select("doc_id", "text"), fit(train))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
