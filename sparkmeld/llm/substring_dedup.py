"""Suffix-array dedup: byte strings of a given length that occur more than once, found by longest-previous-factor arrays.

A suffix array of a whole corpus does not fit a task, but two equal strings of L bytes have equal content, so the least
hashed K-gram inside them (the leftmost of equals) is at the same place. Windows of L bytes are therefore dealt out by
that anchor: the windows of one anchor in a text form a run, and only runs that share an anchor can repeat each other.
Runs with equal bytes are summed up first, so copies in any number cost one run. For the different runs of an anchor a
task builds the lexicographic suffix array of their bytes, takes the longest previous (and following) factor of each
place from the previous and next smaller positions in suffix order, and reports the windows whose factor reaches L. An anchor with many different runs is split
first: by parts of the offsets that a window can have to its anchor, keyed by the bytes that all windows of the part have in
common. A part is a shorter run: equal ones are summed up again, and one that is alone under its key ends there. So of runs
that differ in one place, only the parts go on that hold this place, but not in all their windows; at a single offset the
key is the window itself, and nothing goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix, raw, seeded, slices, texts

LENGTH = 200
GRAM = 32
#: Different runs of an anchor that one suffix array takes; beyond it the anchor is split by offset.
GROUP = 256
#: Bytes of runs that are put into one suffix array.
BLOCK = 1 << 18
#: Bytes of a text that anchors are chosen in at a time.
SEGMENT = 1 << 18

_BYTES = seeded(256, 33)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every string of k bytes, k a power of two, by doubling."""
    h, n = _BYTES[data], 1
    with np.errstate(over="ignore"):
        while n < k:
            h = h[:-n] * _STEP + h[n:]
            h ^= h >> np.uint64(29)
            n *= 2
            h *= np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2 * n)
        return h ^ (h >> np.uint64(32))


def runs_of(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each run of windows of `length` bytes with one anchor."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty
    out: list[tuple] = []
    wide = length - GRAM + 1
    for lo in range(0, len(data) - length + 1, SEGMENT):
        part = data[lo : lo + SEGMENT + length - 1]
        h = gram_hashes(part, GRAM)
        n_windows = len(part) - length + 1
        # the place stands in a hash's low bits, so that the least is the leftmost of equals
        full = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        full[: len(h)] = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        table = full.reshape(-1, wide)
        # least of each `wide`: suffix minima of one block, prefix minima of the next
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:n_windows], ahead[wide - 1 : wide - 1 + n_windows]) & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out.append((h[at[cut]], at[cut] + lo, cut + lo, np.append(cut[1:], n_windows) - 1 + lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of data[begin:end] for many spans: differences of running sums, made independent of the place."""
    step = np.uint64(seeded(1, seed)[0] | np.uint64(1))
    inverse = np.uint64(pow(int(step), -1, 1 << 64))
    with np.errstate(over="ignore"):
        power = np.ones(len(data) + 1, np.uint64)
        back = np.ones(len(data) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(data), step), out=power[1:])
        np.multiply.accumulate(np.full(len(data), inverse), out=back[1:])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:-1])))
        return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all suffixes in lexicographic order, length of the common prefix of each with the one before it).

    Prefix doubling: suffixes are ranked by as many codes as fit a word, then by twice as many in each round, of which
    only those that still agree with another take part. The ranks of the rounds give the common prefixes.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = int(codes.max() + 1).bit_length()
    k = max(63 // bits, 1)
    padded = np.concatenate((codes.astype(np.int64) + 1, np.zeros(k, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    slots, key = np.arange(n), key[order]
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1  # the end is before all else
    levels = []
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[order[slots]] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            break
        levels.append((k, rank.copy()))
        open_ = order[slots]
        key = rank[open_] * (n + 2) + rank[np.minimum(open_ + k, n)] + 1
        o = np.argsort(key)
        order[slots], key = open_[o], key[o]
        k *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k, ranks in reversed(levels):
        step = np.where(ranks[a] == ranks[b], k, 0)
        common[1:] += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    alike = np.ones(n - 1, bool)
    for _ in range(levels[0][0] - 1 if levels else max(63 // bits, 1) - 1):
        alike &= (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        common[1:] += alike
        a, b = a + 1, b + 1
    return order, common


def _smaller_before(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest before it in suffix order that starts at a smaller place; 0 without any.

    common[i] is that of i with i - 1. Candidates jump to their own candidates, all at once, until they are smaller.
    """
    near, least = np.arange(len(place)) - 1, common.copy()
    open_ = np.arange(1, len(place))
    while len(open_):
        open_ = open_[place[near[open_]] > place[open_]]
        to = near[open_]
        least[open_], near[open_] = np.minimum(least[open_], least[to]), near[to]
        least[open_[near[open_] < 0]] = 0
        open_ = open_[near[open_] >= 0]
    if len(least):
        least[0] = 0
    return least


def longest_factors(codes: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the longest string from there on that also starts at an earlier place, and at a later one.

    Among all smaller (greater) places the previous and the next in suffix order share the longest prefix. Factors
    shorter than `least` are given as 0: where neighbours in suffix order share less, no longer factor goes across.
    """
    order, common = suffix_array(codes)
    joined = common >= least
    near = joined | np.append(joined[1:], False) if len(joined) else joined
    rows, c = order[near], np.where(joined, common, 0)[near]
    back = np.concatenate(([0], c[:0:-1])) if len(c) else c
    out = []
    for place in (rows, -rows):
        found = np.maximum(_smaller_before(place, c), _smaller_before(place[::-1], back)[::-1])
        out.append(np.zeros(len(codes), np.int64))
        out[-1][rows] = np.where(found >= least, found, 0)
    return out[0], out[1]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


_RUN = "k binary, anchor long, c1 long, c2 long, a int, b int, m int"


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """docs(k, text) -> one row per run: text key, anchor, hashes of the run's bytes, its first and last window, the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                data, at = raw(texts(part))
                owners: list[np.ndarray] = []
                cols: list[list] = [[] for _ in range(6)]
                for i in np.flatnonzero(np.diff(at) >= length):
                    text = data[at[i] : at[i + 1]]
                    h, m, a, b = runs_of(text, length)
                    for lo in range(0, len(a), 8192):  # spans of a very long text are hashed piece by piece
                        s = slice(lo, lo + 8192)
                        base = a[lo]
                        piece = text[base : b[s][-1] + length]
                        owners.append(np.full(len(a[s]), i, np.int64))
                        for col, x in zip(cols, (h[s].view(np.int64), _span_hash(piece, a[s] - base, b[s] + length - base, 51).view(np.int64), _span_hash(piece, a[s] - base, b[s] + length - base, 52).view(np.int64) ^ (m[s] - a[s]), a[s], b[s], m[s]), strict=True):
                            col.append(x)
                if owners:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(owners))), *(pa.array(np.concatenate(c), pa.int64() if j < 3 else pa.int32()) for j, c in enumerate(cols))], ["k", "anchor", "c1", "c2", "a", "b", "m"])

    return docs.select("k", "text").mapInArrow(run, _RUN)


_CUT = "part long, anchor long, c1 long, c2 long, copies long, k binary, a int, m int, lo int, hi int, run binary"


def _split(rows: DataFrame, length: int) -> DataFrame:
    """Runs with offsets lo..hi to thirds or halves of them: shorter runs, keyed by the bytes that all windows of a part have in common."""

    def digest(data: bytes, size: int, *place: int) -> bytes:
        return hashlib.blake2b(data, digest_size=size, key=":".join(map(str, place)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            out: dict[str, list] = {x: [] for x in got}
            for i, text in enumerate(got["run"]):
                m, first = got["m"][i], got["a"][i]
                far, close = m - first, m - (first + len(text) - length)  # offsets of the first and last window
                lo, hi = got["lo"][i], got["hi"][i]
                cuts = np.linspace(lo, hi + 1, 4 if hi - lo > 120 else 3).astype(int)
                for x, y in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist(), strict=True):
                    if x > far or y < close:
                        continue
                    common = text[far - x : far - y + length]  # window with offset d begins at far - d
                    begin, last = min(y, far), max(x, close)
                    own = text[far - begin : far - last + length]
                    c = np.frombuffer(digest(own, 16, x, y, begin), np.int64).tolist()
                    new = {"part": int.from_bytes(digest(common, 8, x, y), "little", signed=True), "c1": c[0], "c2": c[1], "a": m - begin, "lo": x, "hi": y, "run": own}
                    for col in out:
                        out[col].append(new.get(col, got[col][i]))
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    return rows.mapInArrow(run, _CUT)


def _matched(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Rows of small parts -> (k, a, b): the windows of single runs that repeat, by suffix arrays of many parts at a time."""

    def solve(group: list[tuple]) -> Iterator[tuple]:
        group = sorted(group, key=lambda row: row[2:4])  # in the order of their texts, so that a place is its own rank
        codes = []
        for n, row in enumerate(group):
            codes += [np.frombuffer(row[-1], np.uint8).astype(np.int64), np.array([256 + n])]  # no match runs on into the next
        codes = np.concatenate(codes)
        earlier, later = longest_factors(codes, length)
        found = earlier >= length if keep_first else (earlier >= length) | (later >= length)
        first = 0
        for _, copies, k, a, text in group:
            if copies == 1 or keep_first:
                for x, y in zip(*_ranges(found[first : first + len(text) - length + 1]), strict=True):
                    yield k, a + int(x), a + int(y)
            first += len(text) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, last = 0, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            k, a, b = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["k", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if row[0] != last and size >= BLOCK:
                    out += solve(group)
                    group, size = [], 0
                    if len(out) > 50_000:
                        yield flush()
                        out = []
                last = row[0]
                group.append(row)
                size += len(row[-1])
        if group:
            out += solve(group)
        yield flush()

    ordered = rows.select("part", "copies", "k", "a", "run").repartition("part").sortWithinPartitions("part", "k", "a")
    return ordered.mapInArrow(run, "k binary, a int, b int")


def repeated_windows(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """docs(k, text), k a key of the row -> (k, a, b): starts a..b of strings of `length` bytes that also start elsewhere.

    With keep_first, those that also start earlier (in a text with a lesser key, or before in the same text).
    """
    runs = materialize(run_table(docs, length), "runs")
    # a table of its own: a join can split a hot anchor only where both its sides are plain shuffles
    again = materialize(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "again")
    some = materialize(runs.join(again, "anchor", "left_semi"), "runs")
    discard(runs)
    discard(again)
    place = F.struct("k", "a", "b", "m")
    kinds = materialize(some.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")), "kinds")
    many = kinds.where("copies > 1").select("anchor", "c1", "c2", "first")
    copied = some.join(many, ["anchor", "c1", "c2"])
    if keep_first:
        copied = copied.where((F.col("k") != F.col("first.k")) | (F.col("a") != F.col("first.a")))
    found = materialize(copied.select("k", "a", "b"), "windows")
    differ = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "differ")
    wanted = kinds.join(differ, "anchor").select("anchor", "c1", "c2", "copies", "n", "first.*")
    per_text = wanted.groupBy("k").agg(F.collect_list(F.struct("anchor", "c1", "c2", "copies", "n", "a", "b", "m")).alias("runs"))  # as many as a text has

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "anchor", "c1", "c2", "copies", "k", "a", "m", "lo", "hi", "run", "n"]
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                rows = []
                for k, text, runs in zip(part.column(0).to_pylist(), texts(part).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogateescape")
                    rows += [(r["anchor"], r["anchor"], r["c1"], r["c2"], r["copies"], k, r["a"], r["m"], 0, length - GRAM, data[r["a"] : r["b"] + length], r["n"]) for r in runs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), cut_types, strict=True)], names)

    i64, i32 = pa.int64(), pa.int32()
    cut_types = [i64, i64, i64, i64, i64, pa.binary(), i32, i32, i32, i32, pa.binary(), i64]
    cuts = docs.select("k", "text").join(per_text, "k").select("k", "text", "runs").mapInArrow(cut, _CUT + ", n long")
    cuts = materialize(cuts.dropDuplicates(["part", "c1", "c2"]) if keep_first else cuts, "cuts")  # rows repeated whole cut theirs twice
    answers = [found, _matched(cuts.where(F.col("n") <= GROUP), length, keep_first)]
    large = cuts.where(F.col("n") > GROUP).drop("n")
    while not large.isEmpty():
        parts = materialize(_split(large, length), "parts")
        alike = parts.groupBy("part", "c1", "c2").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("copies"), F.min(F.struct("k", "a", "m", "anchor", "lo", "hi", "run")).alias("first"))
        alike = materialize(alike.select("part", "c1", "c2", "members", "copies", "first.*"), "alike")
        several = alike.where("members > 1").select("part", "c1", "c2", F.struct("k", "a").alias("first"))
        repeats = parts.join(several, ["part", "c1", "c2"])  # whole parts; those of summed runs are known already
        repeats = repeats.where((F.col("k") != F.col("first.k")) | (F.col("a") != F.col("first.a"))) if keep_first else repeats.where("copies = 1")
        answers.append(materialize(repeats.select("k", "a", (F.col("a") + F.length("run") - length).alias("b")), "windows"))
        discard(parts)
        sizes = materialize(alike.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        both = materialize(alike.join(sizes, "part").select(*parts.columns, "n"), "parts")
        discard(alike)
        discard(sizes)
        answers.append(_matched(both.where(F.col("n") <= GROUP), length, keep_first))
        large = both.where(F.col("n") > GROUP).drop("n")
    out = answers[0]
    for x in answers[1:]:
        out = out.unionByName(x)
    return out


def without_repeats(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary): texts without repeated strings of `length` bytes.

    keep_first leaves the occurrence in the least doc_id (integers, none twice) where it is.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # 128 bits of a row, or what sorts like its doc_id
    key = F.unhex(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")) if keep_first else F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.length("text"), F.lit(-1)), "text").cast("binary")))
    keyed = docs.select(key.alias("k"), "doc_id", "text")
    flags = repeated_windows(keyed, length=length, keep_first=keep_first).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("windows"))  # as many as a text has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 21):
                data, at = raw(texts(part))
                rows = []
                offsets = part.column(2)
                for i in range(part.num_rows):
                    text = data[at[i] : at[i + 1]]
                    own = offsets[i].as_py()
                    if own:
                        step = np.zeros(len(text) + 1, np.int64)
                        np.add.at(step, [w["a"] for w in own], 1)
                        np.add.at(step, [w["b"] + length for w in own], -1)
                        gone = np.cumsum(step)[:-1] > 0
                        spans, kept = len(_ranges(gone)[0]), text[~gone].tobytes()
                        rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                    else:
                        kept = text.tobytes()
                        rows.append((len(text), 0, 0, hashlib.sha256(kept).hexdigest(), kept))
                n, r, s, h, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h), pa.array(t, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return keyed.join(flags, "k", "left").select("doc_id", "text", "windows").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, the bytes and runs removed as repeated 200-byte strings, and a digest of the rest.

    Null texts are empty; texts under 200 bytes lose nothing; rows repeated whole remove each other. An empty table gives
    no rows.
    """
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
