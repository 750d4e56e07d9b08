"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are grouped into size classes (powers of two of their distinct shingles). For each class a document of any
length is looked at in windows of twice the class's largest size that overlap by half, so that an item inside a long
document lies whole in some window and its Jaccard similarity to that window is bounded from below by its containment.
One hash per shingle gives a one-permutation signature (a least hash in each of a number of bins) of items and
windows; a window that agrees with an item in any bin makes the document a candidate for it, and the share of the
item's distinct shingles that the document holds decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, mix, raw, shingle_hashes, slices, texts, word_hashes

WIDTH = 5
THRESHOLD = 0.8
#: Bins of a signature. At containment 0.8 an item shares a fifth of the union of its window at least, so that all of
#: 32 bins disagree with probability below 0.001; at containment 1 below 0.0001.
BINS = 32
#: Shingles of test items that one broadcast index may hold; more items are searched in blocks of that many.
BLOCK_SHINGLES = 4_000_000

_SIGN = np.uint64(0xA0761D6478BD642F)


@dataclass
class Index:
    """Items of one block: ids, distinct shingles (sorted by item), and by size class the (bin, least hash) entries of their signatures."""

    ids: list
    begin: np.ndarray
    shingles: np.ndarray
    classes: list[tuple[int, np.ndarray, np.ndarray]]  # windows' size, sorted entries, item of each entry


def signature(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) least hash of each owner's shingles in each bin; the greatest value where a bin is empty."""
    out = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    s = mix(h ^ _SIGN)
    np.minimum.at(out, owner * BINS + (s >> np.uint64(59)).astype(np.int64), s)
    return out.reshape(n, BINS)


def item_shingles(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, in reading order; lower-cased words of letters and digits."""
    return shingle_hashes(*word_hashes(*raw(pc.utf8_lower(arr))), WIDTH)


def build(items: list[tuple]) -> Index:
    """items: (id, text), none twice. Items without words match nothing."""
    items = [x for x in items if x[0] is not None]
    h, n = item_shingles(pa.array([x[1] or "" for x in items], pa.large_string()))
    sets = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(items) else []
    sizes = np.array([len(x) for x in sets], np.int64)
    shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    classes = []
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for c in sorted(set(level[sizes > 0])):
        own = np.flatnonzero((level == c) & (sizes > 0))
        sig = signature(np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), sizes[own]), len(own))
        # items of a class have few shingles for many bins: an empty bin borrows nothing, so it can't match
        full = sig != np.iinfo(np.uint64).max
        entry, item = sig[full], own[np.nonzero(full)[0]]
        o = np.argsort(entry, kind="stable")
        classes.append((2 << int(c), entry[o], item[o]))
    return Index([x[0] for x in items], np.concatenate(([0], np.cumsum(sizes))), shingles, classes)


def search(index: Index, arr: pa.Array, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, int]]:
    """(row of arr, item of the index, its distinct shingles found, its distinct shingles) wherever the share reaches the threshold."""
    if not index.classes or not len(arr):
        return
    h, n = item_shingles(arr)
    s = mix(h ^ _SIGN)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - (ends - n)[owner]
    found = []
    for size, entry, item in index.classes:
        half = size // 2
        halves = np.maximum(1, -(-n // half))
        first = np.cumsum(halves) - halves
        cell = first[owner] + place // half
        key = cell * BINS + (s >> np.uint64(59)).astype(np.int64)
        # least hash of each (half window, bin)
        o = np.argsort(key, kind="stable")
        k = key[o]
        if not len(k):
            continue
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        low, cells = np.minimum.reduceat(s[o], cut), k[cut]
        # a window is two halves: the least of it is the lesser of theirs
        nxt = np.searchsorted(cells, cells + BINS)
        ok = (nxt < len(cells)) & (cells[np.minimum(nxt, len(cells) - 1)] == cells + BINS)
        same = np.zeros(len(cells), bool)
        doc = np.searchsorted(first, cells // BINS, "right") - 1
        same[ok] = doc[nxt[ok]] == doc[ok]
        with_next = np.where(same, np.minimum(low, low[np.minimum(nxt, len(low) - 1)]), low)
        prv = np.searchsorted(cells, cells - BINS)
        back = (prv < len(cells)) & (cells[np.minimum(prv, len(cells) - 1)] == cells - BINS)
        back &= doc[np.minimum(prv, len(doc) - 1)] == doc
        with_last = np.where(back, np.minimum(low, low[np.minimum(prv, len(low) - 1)]), low)
        for least in (with_next, with_last):
            a, b = np.searchsorted(entry, least, "left"), np.searchsorted(entry, least, "right")
            hit = np.flatnonzero(b > a)
            if len(hit):
                times = (b - a)[hit]
                at = np.repeat(a[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                found.append(np.stack([np.repeat(doc[hit], times), item[at]], axis=1))
    if not found:
        return
    for d, i in np.unique(np.concatenate(found), axis=0):
        want = index.shingles[index.begin[i] : index.begin[i + 1]]
        got = int(np.isin(want, h[ends[d] - n[d] : ends[d]]).sum())
        if got >= threshold * len(want):
            yield int(d), int(i), got, len(want)


def _indexes(spark: SparkSession, benchmark: DataFrame, block_shingles: int) -> Iterator[tuple[Broadcast, bool]]:
    """(index of a block of items, whether there are more blocks than it), one at a time: the next call destroys the last.

    The driver and a task hold one block, whose shingles are bounded, however large the benchmark is.
    """
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    weigh = F.ceil(F.length("text") / 4) + 1
    total = items.agg(F.coalesce(F.sum(weigh), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_shingles))
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(build([(r.item_id, r.text) for r in own.toLocalIterator()]))
        yield shared, blocks > 1
        if blocks > 1:
            shared.destroy()


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_found, n_item, containment) of every document that holds `threshold` of an item's shingles.

    Items are gathered in blocks of bounded size; one pass over the documents is made for each block, and where there
    are several each pass is written before the next. Null or wordless texts and items match nothing; items under five
    words are one shingle; repeated item ids count once (least text). Each row is searched by itself, so rows of one
    doc_id give rows of their own. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, n_found long, n_item long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for shared, several in _indexes(spark, benchmark, block_shingles):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "n_found", "n_item"]
            for batch in batches:
                for part in slices(batch, budget=1 << 20):
                    rows = list(search(shared.value, texts(part), threshold))
                    if rows:
                        d, i, got, want = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([shared.value.ids[x] for x in i], item_type), pa.array(got, pa.int64()), pa.array(want, pa.int64())], names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        part = materialize(part, "found") if several else part
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs, with all their columns, whose own text holds no item."""
    out = docs
    for shared, several in _indexes(spark, benchmark, block_shingles):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, budget=1 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in search(shared.value, texts(part), threshold)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
        out = materialize(out, "clean") if several else out
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) where the document holds at least 0.8 of the item's distinct five-word shingles.

    Null or empty texts and items match nothing, ties and repeated rows are all returned, empty tables give no rows.
    """
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
