"""MinHash near-dedup by DartMinHash over weighted five-word shingles, banded joining and exact verification.

Every unit of a shingle's weight (its occurrences) is a region that darts fall into along a rank axis, as a Poisson
process drawn from the region's hash: the same darts in every document that holds the region. Only ranks up to a bound
that yields a few hundred darts a document are thrown, each dart hashes to a coordinate, and the earliest dart of each
coordinate is the signature. Documents with the same words are one class before anything is compared. Classes that
share a band are compared to the band's pivot. Bands that still hold several components afterwards are compared whole:
small ones pair by pair, large ones in pairs of blocks, each a task of bounded size that reports a spanning forest. So no
link between components is missed, and no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix, raw, seeded, shingle_hashes, slices, texts, word_hashes
from .graph import components

WIDTH = 5
THRESHOLD = 0.8
#: Coordinates of a signature, and of a band: at similarity 0.8 all 16 bands differ with probability 0.0003.
COORDINATES, ROWS = 64, 4
BANDS = COORDINATES // ROWS
#: Darts per coordinate: coordinates stay empty in one document of fifty, which is then thrown at further.
DARTS = np.log(COORDINATES) + 4
#: Classes of a band whose remaining pairs are listed; larger bands are compared in blocks of so many classes.
LISTED, BLOCK = 12, 400
#: Rows of ids that a join may broadcast, at most 16 MB of them.
BROADCAST_ROWS = 1_000_000

_SALT = seeded(8, 21)


def regions(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region hashes text by text, sorted within a text; their number; a 128-bit key of the word sequence as two columns)."""
    words, n_words = word_hashes(*raw(pc.utf8_lower(arr)))
    h, n = shingle_hashes(words, n_words, WIDTH)
    owner = np.repeat(np.arange(len(n)), n)
    key = np.zeros((len(n), 2), np.uint64)
    full = np.flatnonzero(n > 0)
    first = (np.cumsum(n) - n)[full]
    with np.errstate(over="ignore"):
        if len(full):
            place = (np.arange(len(h)) - np.repeat(first, n[full])).astype(np.uint64)
            for j in (0, 1):
                key[full, j] = np.add.reduceat(mix(h ^ _SALT[j] + place * _SALT[2]), first)
        o = np.lexsort((h, owner))
        h = h[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
        again = nth > 0
        h[again] = mix(h[again] + nth[again].astype(np.uint64) * _SALT[3])
    return h, n, key


def dart_signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) hash of the earliest dart of each coordinate; texts without regions have zeros."""
    out = np.zeros((len(n), COORDINATES), np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    bound = np.where(n > 0, COORDINATES * DARTS / np.maximum(n, 1), 0.0)
    todo = n > 0
    while todo.any():
        keep = todo[owner]
        region, doc = h[keep], owner[keep]
        rank, q = np.zeros(len(region)), 0
        docs, ranks, darts = [], [], []
        while len(region):
            q += 1
            with np.errstate(over="ignore"):
                draw = mix(region + np.uint64(q) * _SALT[4])
            rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < bound[doc]
            region, doc, rank = region[on], doc[on], rank[on]
            docs.append(doc)
            ranks.append(rank)
            darts.append(mix(draw[on] ^ _SALT[5]))
        doc, rank, dart = np.concatenate(docs), np.concatenate(ranks), np.concatenate(darts)
        cell = doc * COORDINATES + (dart >> np.uint64(58)).astype(np.int64)
        o = np.lexsort((dart, rank, cell))
        cell, dart = cell[o], dart[o]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        hit = cell[first]
        done = np.bincount(hit // COORDINATES, minlength=len(n)) == COORDINATES
        done &= todo
        take = done[hit // COORDINATES]
        out.reshape(-1)[hit[take]] = dart[first][take]
        todo = todo & ~done
        bound[todo] *= 2
    return out


def sketch(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, k1, k2, n, bands): word-sequence key, shingle weight, and the hash of each band (none without words)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                h, n, k = regions(texts(part))
                sig = dart_signatures(h, n).reshape(-1, BANDS, ROWS)
                with np.errstate(over="ignore"):
                    band = mix((sig * _SALT[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _SALT[6]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))), pa.int32()), pa.array(band[n > 0].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k[:, 0].view(np.int64)), pa.array(k[:, 1].view(np.int64)), pa.array(n, pa.int64()), lists], ["id", "k1", "k2", "n", "bands"])

    return docs.select(F.col(key).alias("id"), "text").mapInArrow(run, f"id {kind}, k1 long, k2 long, n long, bands array<bigint>")


def region_table(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (id, regions): the sorted region hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                h, n, _ = regions(texts(part))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.sort(h[e - m : e]).tobytes() for e, m in zip(ends, n, strict=True)], pa.binary())], ["id", "regions"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, regions binary")


def _small(table: DataFrame) -> DataFrame:
    """A written table of one or two ids a row, to be broadcast if its counted rows are within the bound."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def verified(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Of pairs(u, v): those whose weighted Jaccard similarity reaches the threshold, with it."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            sim = np.zeros(len(a))
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x):
                    both = np.concatenate((x, y))
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    sim[i] = same / (len(both) - same)
            keep = pa.array(np.flatnonzero(sim >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sim).take(keep)], ["u", "v", "similarity"])

    full = table.select(F.col("id").alias("u"), F.col("regions").alias("ru")).join(_small(pairs), "u").join(table.select(F.col("id").alias("v"), F.col("regions").alias("rv")), "v")
    return full.select("u", "v", "ru", "rv").mapInArrow(run, f"u {kind}, v {kind}, similarity double")


def _across_blocks(bands: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """bands(band, class_id, component, m) -> (u, v, similarity): links that connect all components that links within a band connect."""
    kind = bands.schema["class_id"].dataType.simpleString()
    blocks = bands.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    dealt = blocks.select("band", "class_id", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", "component", F.col("class_id").alias("id"), "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values(["own", "id"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["regions"]]
        n = np.array([len(x) for x in sets])
        code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        shared = np.cumsum(count > 1) - 1  # regions of one class only are in no intersection
        row = np.repeat(np.arange(len(sets)), n)
        keep = count[code] > 1
        row, col = row[keep], shared[code[keep]]
        same = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(col.max(initial=-1)) + 1, 8192):
            part = np.zeros((len(sets), 8192), np.float32)
            own = (col >= lo) & (col < lo + 8192)
            part[row[own], col[own] - lo] = 1
            same += part @ part.T
        similar = same / (n[:, None] + n[None, :] - same)
        comp, block = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1], pdf["own"].to_numpy()
        new = np.triu((similar >= threshold - 1e-7) & (comp[:, None] != comp[None, :]), 1)
        if pdf["p"].iloc[0] != pdf["q"].iloc[0]:
            new &= block[:, None] != block[None, :]
        parent = list(range(int(comp.max(initial=0)) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        ids = pdf["id"].to_numpy()
        for i, j in zip(*(x.tolist() for x in np.nonzero(new)), strict=True):
            a, b = root(comp[i]), root(comp[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j]), float(similar[i, j])))
        return pd.DataFrame(out, columns=["u", "v", "similarity"])

    return dealt.join(table, "id").groupBy("band", "p", "q").applyInPandas(link, f"u {kind}, v {kind}, similarity double").dropDuplicates(["u", "v"])


def _distinct(docs: DataFrame, key: str) -> bool:
    """Whether every row has a key, and one of its own."""
    n, n_keys = docs.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    return n == n_keys


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, component_id, n_links) of every row of docs(key, text).

    class_id: the least key among documents with the same words; component_id: the least key reachable over links of
    similarity >= threshold between classes; n_links: verified links of the class (to pivots, not to all members of its
    component). Texts that are null, empty or without words are each alone. Rows with one key are documents of their
    own, and so are those with a null key, whose class and component is null if all its keys are. Repeated rows share a
    class.
    """
    if _distinct(docs, key):
        return _grouped(docs.select(key, "text"), key, threshold)
    rows = materialize(docs.select(F.col(key).alias("key"), "text", F.monotonically_increasing_id().alias("id")), "rows")
    groups = materialize(_grouped(rows.select("id", "text"), "id", threshold).join(rows.select("id", "key"), "id"), "groups")
    least = lambda by, name: groups.groupBy(by).agg(F.min("key").alias(name))
    out = groups.join(least("class_id", "class_key"), "class_id").join(least("component_id", "component_key"), "component_id")
    return out.select(F.col("key").alias(key), F.col("class_key").alias("class_id"), F.col("component_key").alias("component_id"), "n_links")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component that with the least key, then the least text."""
    if _distinct(docs, key):
        gone = materialize(_grouped(docs.select(key, "text"), key, threshold).where(F.col(key) != F.col("component_id")).select(key), "gone")
        return docs.join(_small(gone), key, "left_anti")
    rows = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "rows")
    field = lambda name: F.col("row").getField(name)
    groups = _grouped(rows.select("id", field("text").alias("text")), "id", threshold).select("id", "component_id")
    stays = rows.join(groups, "id").groupBy("component_id").agg(F.min(F.struct(field(key).isNull().alias("none"), field(key).alias("key"), field("text").alias("text"), "id")).alias("least"))
    return rows.join(materialize(stays.select("least.id"), "stays"), "id", "left_semi").select(*[field(c).alias(c) for c in docs.columns])


def _grouped(docs: DataFrame, key: str, threshold: float) -> DataFrame:
    """near_duplicates() of docs(key, text) whose keys are distinct and not null."""
    sketched = materialize(sketch(docs, key), "sketch")
    classes = sketched.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.any_value("bands").alias("bands"))
    entries = classes.select("class_id", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("class_id").alias("pivot")).where("m > 1")
    left = materialize(entries.join(shared, "band").select("band", "class_id", "pivot"), "bands")
    links = None
    if not left.isEmpty():
        wanted = left.select(F.col("class_id").alias(key)).distinct()
        wanted = materialize(wanted, "wanted")
        table = materialize(region_table(docs.join(_small(wanted), key, "left_semi").select(F.col(key).alias("id"), "text")), "regions")
        pairs = materialize(left.where("class_id <> pivot").select(F.col("class_id").alias("u"), F.col("pivot").alias("v")).distinct(), "pairs")
        links = materialize(verified(pairs, table, threshold).dropDuplicates(["u", "v"]), "links")
        found = materialize(components(links.select("u", "v")), "found")
        # the pivot has met all others of its band; what else is unconnected has not
        rest = left.where("class_id <> pivot").select("band", "class_id").join(found.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        rest = materialize(rest, "bands")
        discard(left)
        sizes = rest.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "m")
        open_bands = materialize(rest.join(sizes, "band"), "bands")
        discard(rest)
        few = open_bands.where(F.col("m") <= LISTED)
        other = few.select("band", F.col("class_id").alias("v"), F.col("component").alias("cv"))
        listed = few.select("band", F.col("class_id").alias("u"), F.col("component").alias("cu")).join(other, "band").where("u > v and cu <> cv").select("u", "v").distinct()
        listed = materialize(listed.join(pairs, ["u", "v"], "left_anti"), "pairs")
        more = [verified(listed, table, threshold).dropDuplicates(["u", "v"])] if not listed.isEmpty() else []
        many = open_bands.where(F.col("m") > LISTED)
        if not many.isEmpty():
            more.append(_across_blocks(many, table, threshold))
        for x in more:
            links = links.unionByName(materialize(x, "links"))
    member = sketched.select(F.col("id").alias(key), "k1", "k2", "n").join(classes.select("k1", "k2", "class_id"), ["k1", "k2"], "left")
    member = member.withColumn("class_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col(key))).select(key, "class_id")
    if links is None:
        return member.select(key, "class_id", F.col("class_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    found = materialize(components(links.select("u", "v")), "found").select(F.col("id").alias("class_id"), "component")
    ends = links.select(F.col("u").alias("class_id")).unionByName(links.select(F.col("v").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    found = found.join(ends, "class_id", "left")
    out = member.join(found, "class_id", "left")
    return out.select(key, "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, its near-duplicate component and whether it is the one that stays of it.

    Null, empty and wordless texts are alone and stay; an empty table gives no rows; repeated rows share a class. The
    number of links that were verified, which depends on the bands' pivots, is near_duplicates()' and not the query's.
    """
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("n_links")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
