"""Embedding near-dedup by a random-projection tree forest.

Each tree splits unit vectors recursively at the median of a random projection; a vector near a split goes down both
sides (spill overlap). The upper splits of every tree are fitted on a bounded sample, and again on one of each branch
that is still too large; a branch of bounded size goes to a task, which splits on in memory down to small leaves and
compares the vectors of each leaf in single precision, a little below the threshold. So a vector is sent once for each
branch and not for each leaf, and only vectors that meet a neighbour go on: these are compared in double precision, leaf
by leaf. A pair that meets in several leaves is counted in the least of them only, and a leaf reports counts and least
ids, never its pairs. A large branch that cannot be split (near copies in any number) is compared in pairs of blocks,
each a task of its own, and where such a branch of another tree holds vectors that have met in one already, only those
that have not are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialize
from .graph import components

THRESHOLD = 0.95
#: A pair at the threshold is parted by a split with probability 0.02, so that over 12 levels (a million vectors) all
#: trees part it with probability 0.00003; closer pairs far less.
TREES = 7
#: Rows of the sample that the first splits are fitted on, and of each branch that is split again.
SAMPLE = 20_000
BRANCH_SAMPLE = 2_000
#: Vectors in a branch that one task takes, in a leaf, and in a block of a branch that cannot be split.
BRANCH = 8_192
LEAF = 512
BLOCK = 1_024
#: Half width of the overlap at a split, in standard deviations of what projections of linked vectors differ by.
SPILL = 0.5
#: Both sides of a split together, as a multiple of what is split, at most.
MOST_OVERLAP = 1.35
#: Splits of a branch in one round, and rounds.
LEVELS, ROUNDS = 6, 12
#: What single precision may be wrong by.
SINGLE = 1e-5
#: Rows of a matrix of similarities, and leaves in a matrix of memberships, that are worked on at a time.
CHUNK, NAMES = 512, 2_048
#: Blocks that a join may broadcast.
BROADCAST_BLOCKS = 100_000


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, whether each can be compared): null, zero, odd-sized or non-finite ones cannot."""
    out, ok = np.zeros((len(column), dim)), np.zeros(len(column), bool)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and dim and None not in v:
            x = np.asarray(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                out[i], ok[i] = x / np.sqrt(x @ x), True
    return out, ok


def _direction(tree: int, node: int, dim: int) -> np.ndarray:
    """The projection of a node: the same wherever it is asked for."""
    v = np.random.default_rng([tree, node & 0xFFFFFFFF, node >> 32]).standard_normal(dim)
    return v / np.linalg.norm(v)


def _overlap(dim: int, threshold: float) -> float:
    return SPILL * np.sqrt(max(2 - 2 * threshold, 0) / max(dim, 1))


def split_fit(x: np.ndarray, tree: int, root: int, levels: int, stop: int, width: float) -> dict[int, float]:
    """Thresholds of the nodes below root: medians of the sample's projections; a node of `stop` sample rows or fewer is a leaf."""
    out: dict[int, float] = {}
    level = {1: np.arange(len(x))}
    for _ in range(levels):
        nxt = {}
        for node, rows in level.items():
            if len(rows) <= stop:
                continue
            p = x[rows] @ _direction(tree, root * 1_000_003 + node, x.shape[1])
            cut = float(np.median(p))
            left, right = rows[p <= cut + width], rows[p > cut - width]
            if len(left) + len(right) > MOST_OVERLAP * len(rows):
                continue  # the overlap holds too much: little is separated here
            out[node] = cut
            nxt[2 * node], nxt[2 * node + 1] = left, right
        level = nxt
    return out


def split_apply(x: np.ndarray, tree: int, root: int, cuts: dict[int, float], width: float) -> list[tuple[int, np.ndarray]]:
    """(leaf node, rows of x in it), rows near a split in both of its sides."""
    done, level = [], [(1, np.arange(len(x)))]
    while level:
        node, rows = level.pop()
        if node not in cuts:
            if len(rows):
                done.append((node, rows))
            continue
        p = x[rows] @ _direction(tree, root * 1_000_003 + node, x.shape[1])
        level += [(2 * node, rows[p <= cuts[node] + width]), (2 * node + 1, rows[p > cuts[node] - width])]
    return done


def _below(leaf: int, node: int) -> int:
    """A 63-bit name of a leaf's node, the same in every run."""
    return (leaf * 1_000_003 + node * 8_191 + 12_345) % ((1 << 61) - 1)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def forest(vectors: DataFrame, dim: int, n: int, threshold: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """vectors(id, x) -> (branch, tree, id) of branches that a task takes, (leaf, id) of those that cannot be split, and the tables these read."""
    width = _overlap(dim, threshold)
    sample = bounded_sample(vectors, SAMPLE, n, ("id", "x")).orderBy("id").select("x").collect()
    x = np.stack([np.frombuffer(r.x, np.float64) for r in sample]) if sample else np.zeros((0, dim))
    share = len(x) / max(n, 1)
    trees = {t: split_fit(x, t, 0, 40, max(int(0.75 * BRANCH * share), 32), width) for t in range(TREES)}
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for t, cuts in shared.value.items():
                for node, rows in split_apply(x, t, 0, cuts, width):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), _below(t + 1, node))), pa.array(np.full(len(rows), t, np.int32)), batch.column(0).take(pa.array(rows))], ["leaf", "tree", "id"])

    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"leaf long, tree int, id {kind}"
    placed = materialize(vectors.mapInArrow(first, schema), "branches")
    tables, small, stuck = [placed], [], []
    for _ in range(ROUNDS):
        sizes = materialize(placed.groupBy("leaf", "tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
        tables.append(sizes)
        if sizes.where(F.col("n") > BRANCH).isEmpty():
            small.append(placed)
            break
        small.append(placed.join(sizes.where(F.col("n") <= BRANCH).select("leaf"), "leaf", "left_semi"))
        large = placed.join(sizes.where(F.col("n") > BRANCH).select("leaf", "n"), "leaf")
        drawn = large.where(F.pmod(F.xxhash64("leaf", "id"), F.lit(1 << 30)) < F.lit(BRANCH_SAMPLE * float(1 << 30)) / F.col("n"))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            leaf, tree, n = int(pdf["leaf"].iloc[0]), int(pdf["tree"].iloc[0]), int(pdf["n"].iloc[0])
            x = np.stack([np.frombuffer(v, np.float64) for v in pdf.sort_values("id")["x"]])
            cuts = split_fit(x, tree, leaf, LEVELS, max(int(0.75 * BRANCH * len(x) / n), 16), width)
            return pd.DataFrame({"leaf": [leaf], "nodes": [list(cuts)], "cuts": [list(cuts.values())]})

        models = drawn.join(vectors, "id").groupBy("leaf", "tree").applyInPandas(fit, "leaf long, nodes array<long>, cuts array<double>")
        models = materialize(models, "cuts")
        tables.append(models)
        stuck.append(placed.join(models.where("size(nodes) = 0").select("leaf"), "leaf", "left_semi"))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, leaf, tree = _matrix(batch.column(3)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for i in np.unique(leaf):
                    own = np.flatnonzero(leaf == i)
                    cuts = dict(zip(batch.column(4)[int(own[0])].as_py(), batch.column(5)[int(own[0])].as_py(), strict=True))
                    for node, rows in split_apply(x[own], int(tree[own[0]]), int(i), cuts, width):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), _below(int(i), node))), pa.array(tree[own[rows]], pa.int32()), batch.column(2).take(pa.array(own[rows]))], ["leaf", "tree", "id"])

        moving = placed.join(models.where("size(nodes) > 0"), "leaf").join(vectors, "id").select("leaf", "tree", "id", "x", "nodes", "cuts")
        placed = materialize(moving.mapInArrow(again, schema), "branches")
        tables.append(placed)
        if placed.isEmpty():
            break
    else:
        stuck.append(placed)
    join = lambda parts: None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(join(parts[1:]))
    none = placed.limit(0)
    return join(small) if small else none, (join(stuck) if stuck else none).select("leaf", "id"), tables


def met_in_branch(x: np.ndarray, tree: int, branch: int, width: float, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x with a neighbour in it) of a branch that is split on in memory; what cannot be split is one leaf."""
    cuts = split_fit(x, tree, branch, 40, LEAF, width)
    for node, rows in split_apply(x, tree, branch, cuts, width):
        own = x[rows]
        some = np.zeros(len(rows), bool)
        for lo in range(0, len(rows), CHUNK):
            near = own[lo : lo + CHUNK] @ own.T >= threshold
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            some[lo : lo + CHUNK] = near.any(1)
        if some.any():
            yield _below(branch, node), rows[some]


def links_of(x: np.ndarray, ids: np.ndarray, w: np.ndarray, lists: list, leaf: int, threshold: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a link, weight of those of its links that meet in no lesser leaf, least id of its component) of one leaf.

    With `apart`, a block of each row, only pairs of different blocks count.
    """
    link = np.empty((len(x), len(x)), bool)
    for lo in range(0, len(x), CHUNK):
        link[lo : lo + CHUNK] = x[lo : lo + CHUNK] @ x.T >= threshold
    np.fill_diagonal(link, False)
    if apart is not None:
        link &= apart[:, None] != apart[None, :]
    some = np.flatnonzero(link.any(1))
    link = link[np.ix_(some, some)]
    lesser = [(r, v) for r, i in enumerate(some) for v in lists[i] if v < leaf]
    count = np.zeros(len(some), np.int64)
    row = np.array([r for r, _ in lesser], np.int64)
    name, place, often = np.unique(np.array([v for _, v in lesser], np.int64), return_inverse=True, return_counts=True)
    keep = often[place] > 1 if len(name) else np.zeros(0, bool)
    row, place = row[keep], (np.cumsum(often > 1) - 1)[place[keep]] if len(name) else place
    for lo in range(0, len(some), CHUNK):
        new = link[lo : lo + CHUNK].copy()
        for first in range(0, int(place.max(initial=-1)) + 1, NAMES):
            own = (place >= first) & (place < first + NAMES)
            member = np.zeros((len(some), NAMES), np.float32)
            member[row[own], place[own] - first] = 1
            new &= member[lo : lo + CHUNK] @ member.T == 0
        count[lo : lo + CHUNK] = new @ w[some]
    return some, count, _least_labels(link, ids[some])


def _least_labels(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each row's component of a symmetric matrix: each row is looked at once."""
    label, open_ = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable"):
        front = np.array([i]) if open_[i] else np.empty(0, np.int64)
        while len(front):
            label[front], open_[front] = ids[i], False
            front = np.flatnonzero(link[front].any(0) & open_)
    return label


_OUT = "id long, n long, least long"


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id long, embedding) -> (vec_id, n_links, component_id, kept).

    Vectors that are null, zero, of another size than the most common one, or hold null or non-finite components link
    with nothing. A null vec_id stays and links with nothing. Rows with one vec_id count as one vector of the least
    content each.
    """
    spark = vectors.sparkSession
    size = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = size.d if size else 0

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = unit_vectors(batch.column(1), dim)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([x[i].tobytes() for i in keep], pa.binary()), pa.array([x[i].astype(np.float32).tobytes() for i in keep], pa.binary())], ["id", "x", "y"])

    good = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(clean, "id long, x binary, y binary")
    good = materialize(good.groupBy("id").agg(F.min(F.struct("x", "y")).alias("v")).select("id", "v.x", "v.y"), "vectors")
    # copies of a vector are one vector with a weight
    classes = materialize(good.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.any_value("y").alias("y")), "classes")
    n = classes.count()
    small, stuck, tables = forest(classes.select("id", "x"), dim, n, threshold)
    width = _overlap(dim, threshold)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows that share their first column, which the input is sorted by."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            first = batch.column(0).to_numpy()
            if batch.num_rows and (held[0].column(0)[0].as_py() != first[-1]):
                table = pa.Table.from_batches(held)
                leaf = table.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield table.slice(a, b - a)
                held = table.slice(cuts[-1]).to_batches()  # the last may go on
            held = [x for x in held if x.num_rows]
        if held:
            yield pa.Table.from_batches(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            branch, tree, ids = table.column(0)[0].as_py(), table.column(1)[0].as_py(), table.column(2).to_numpy()
            for leaf, rows in met_in_branch(_matrix(table.column(3).combine_chunks(), np.float32), tree, branch, width, threshold - SINGLE):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), pa.array(ids[rows])], ["leaf", "id"])

    dealt = small.select(F.col("leaf").alias("branch"), "tree", "id").join(classes.select("id", "y"), "id").select("branch", "tree", "id", "y")
    met = materialize(dealt.repartition("branch").sortWithinPartitions("branch", "id").mapInArrow(meet, "leaf long, id long"), "met")
    stuck = materialize(stuck, "stuck")
    lists = met.unionByName(stuck).groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a few per tree
    full = materialize(classes.select("id", "x", "w").join(lists, "id"), "full")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            ids, w = table.column(1).to_numpy(), table.column(3).to_numpy()
            some, count, label = links_of(_matrix(table.column(2).combine_chunks()), ids, w, table.column(4).to_pylist(), table.column(0)[0].as_py(), threshold)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count), pa.array(label)], ["id", "n", "least"])

    ordered = met.join(full, "id").select("leaf", "id", "x", "w", "leaves").repartition("leaf").sortWithinPartitions("leaf", "id")
    found = [materialize(ordered.mapInArrow(within, _OUT), "links")]
    if not stuck.isEmpty():
        # vectors that met in a lesser branch that cannot be split have been compared there
        settled = stuck.join(stuck.groupBy("id").agg(F.min("leaf").alias("m")), "id")
        sizes = materialize(settled.groupBy("leaf", "m").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes")
        tables.append(sizes)
        others = sizes.select("leaf", F.col("m").alias("m2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b2"))
        others = F.broadcast(others) if sizes.agg(F.sum("blocks")).first()[0] <= BROADCAST_BLOCKS else others
        blocks = settled.join(sizes, ["leaf", "m"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("leaf", "id", "m", "b")
        own, other = F.struct("m", "b"), F.struct(F.col("m2").alias("m"), F.col("b2").alias("b"))
        pairs = blocks.join(others, "leaf").where("m <> m2 or m = leaf").select("leaf", "id", own.alias("own"), F.least(own, other).alias("p"), F.greatest(own, other).alias("q"))
        pairs = pairs.select("leaf", "id", F.xxhash64("own").alias("own"), "p.m", "p.b", F.col("q.m").alias("m2"), F.col("q.b").alias("b2"))

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            x = np.stack([np.frombuffer(v, np.float64) for v in pdf["x"]])
            ids = pdf["id"].to_numpy()
            same = pdf["m"].iloc[0] == pdf["m2"].iloc[0] and pdf["b"].iloc[0] == pdf["b2"].iloc[0]
            # pairs inside a block are another task's
            some, count, label = links_of(x, ids, pdf["w"].to_numpy(), list(pdf["leaves"]), int(pdf["leaf"].iloc[0]), threshold, None if same else pdf["own"].to_numpy())
            return pd.DataFrame({"id": ids[some], "n": count, "least": label})

        found.append(materialize(pairs.join(full, "id").groupBy("leaf", "m", "b", "m2", "b2").applyInPandas(across, _OUT), "links"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    counts = materialize(rows.groupBy("id").agg(F.sum("n").alias("n")), "counts")
    comps = materialize(components(rows.select(F.col("id").alias("u"), F.col("least").alias("v"))), "components").withColumnRenamed("component", "c")
    for table in (*tables, met, stuck, full, *found):
        discard(table)
    of_class = classes.join(counts, "id", "left").join(comps, "id", "left").select("x", F.col("id").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    member = good.select("id", "x").join(of_class, "x").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    out = vectors.select("vec_id").join(member, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it is the one kept of it.

    Vectors that cannot be compared have no links and stay; an empty table gives no rows; repeated rows of a vec_id are
    one vector.
    """
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
