"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are summed on the executors in fixed-size chunks of the bucket space, the log-probability matrix
(buckets x languages) is broadcast, and scoring gathers its rows for the n-grams of whole batches at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, raw, slices, texts

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
CHUNK = 1 << 11
SMOOTHING = 0.5
#: Bound of the labelled sample that the counts are taken from.
MAX_TRAIN_ROWS = 20_000
#: Bound of the lang values that are learned: those of the most rows, equals by name. Rows of others teach nothing.
MAX_LANGUAGES = 256

_LETTER = None


def _letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_buckets(arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (bucket of each character position or BUCKETS where none ends there, first position of each text, letters of each text)."""
    data, at = raw(pc.utf8_lower(arr))
    lead = (data & 0xC0) != 0x80
    begin = np.concatenate(([0], np.cumsum(lead)))[at]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if len(codes) != begin[-1]:  # bytes that are no UTF-8: text by text
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(at[:-1], at[1:], strict=True)]
        codes, begin = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    table = _letter_table()
    letter = table[codes]
    codes[~letter] = 32
    letters = np.diff(np.concatenate(([0], np.cumsum(letter)))[begin])
    starts = begin[:-1][np.diff(begin) > 0]
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        with np.errstate(over="ignore"):
            h[n - 1 :] = h[n - 2 : -1] * np.uint32(0x01000193) + codes[n - 1 :] if n > 1 else codes
            if n in ORDERS:
                g = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
                g ^= g >> np.uint32(15)
                g *= np.uint32(0x85EBCA77)
                bucket = (g >> np.uint32(32 - 15)).astype(np.int32)
                for j in range(n - 1):
                    bucket[np.minimum(starts + j, len(bucket) - 1)] = BUCKETS
        if n in ORDERS:
            yield bucket, begin, letters


@dataclass
class Model:
    """languages: the learned values in order; weights: (BUCKETS + 1, languages) float32, the last row zero; prior: log shares."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def score(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the best language, its posterior, number of letters) of each text."""
        total = np.tile(self.prior.astype(np.float64), (len(arr), 1))
        letters = np.zeros(len(arr), np.int64)
        for bucket, begin, letters in ngram_buckets(arr):  # noqa: B007
            full = np.flatnonzero(np.diff(begin) > 0)
            if len(full):
                total[full] += np.add.reduceat(self.weights[bucket], begin[:-1][full], axis=0)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return best, share, letters


def fit(train: DataFrame, rows: int = MAX_TRAIN_ROWS) -> Model:
    """train(key, text, lang): rows with a null text or lang, no letter, or a lang beyond MAX_LANGUAGES teach nothing."""
    train = train.where("lang is not null and text is not null")
    known = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    sample = bounded_sample(train, rows, sum(r[1] for r in known)).where(F.col("lang").isin([r[0] for r in known]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                lang = part.column(part.schema.get_field_index("lang")).to_pylist()
                known = {x: i for i, x in enumerate(sorted(set(lang)))}
                code = np.array([known[x] for x in lang])
                for order, (bucket, begin, letters) in enumerate(ngram_buckets(texts(part))):
                    owner = np.repeat(np.where(letters > 0, code, len(known)), np.diff(begin))
                    keep = bucket < BUCKETS
                    got = np.bincount(owner[keep] * BUCKETS + bucket[keep], minlength=(len(known) + 1) * BUCKETS).reshape(-1, BUCKETS)
                    for x, i in known.items():
                        sums[x] = sums.get(x, 0) + got[i]
                        if order == 0:
                            docs[x] = docs.get(x, 0) + int((letters[code == i] > 0).sum())
        for x, v in sums.items():
            parts = v.astype(np.float64).reshape(-1, CHUNK)
            full = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_pydict(
                {"lang": [x] * (len(full) + 1), "chunk": pa.array([-1, *full], pa.int32()), "sums": [np.array([docs[x]], np.float64).tobytes(), *(parts[i].tobytes() for i in full)]}
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"lang": pdf["lang"][:1], "chunk": pdf["chunk"][:1], "sums": [total.tobytes()]})

    schema = "lang string, chunk int, sums binary"
    got = sample.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "chunk").applyInPandas(add, schema).collect()
    docs = {r.lang: np.frombuffer(r.sums)[0] for r in got if r.chunk < 0}
    languages = sorted(x for x, n in docs.items() if n > 0)
    counts = np.zeros((BUCKETS + 1, len(languages)))
    for r in got:
        if r.chunk >= 0 and r.lang in languages:
            counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK, languages.index(r.lang)] += np.frombuffer(r.sums)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    weights = np.log((counts + SMOOTHING) / (counts[:BUCKETS].sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)
    weights[BUCKETS] = 0
    n = np.array([docs[x] for x in languages])
    return Model(languages, weights, np.log(n / n.sum()))


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row: `und` and 0.0 for a null text, a text without a letter or an empty model."""
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch):
                arr = texts(part)
                if m.languages:
                    best, share, letters = m.score(arr)
                else:
                    best, share, letters = (np.zeros(len(arr), np.int64) for _ in range(3))
                none = letters == 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[np.where(none, len(m.languages), best)], pa.string()), pa.array(np.where(none, 0.0, share), pa.float64())], ["key", "lang_pred", "score"])

    out = docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out.

    Null or letterless texts: `und`, score 0.0. A null lang teaches nothing. Repeated rows are predicted alike.
    An empty table gives no rows; where nothing can be learned every text is `und`.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(crc_mod("doc_id", 3) != 1).select(F.col("doc_id").alias("key"), "text", "lang")
    out = predict(spark, docs.select("doc_id", "text"), fit(train))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
