"""Shared pieces of the training-data operators: durable intermediate tables, columnar text hashing, stable fractions.

Every hash here is a pure function of the bytes it reads, so a task that is run again after an executor is lost
returns the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; longer texts are cut between words and joined again afterwards.
SEGMENT = 1 << 17

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset only a local master, whose executors are the driver itself, gets a temporary one.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._meld_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_meld_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, mod n: the fold that the held-out contracts fix."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, rows: int, total: int, by: tuple[str, ...] = ("key", "text")) -> DataFrame:
    """About `rows` of the `total` rows of df, by a hash of the columns `by`, so that rows of one key are drawn one by one.

    No shuffle, no single task, repeatable. Rows equal in all of these columns are all in or all out.
    """
    if total <= rows:
        return df
    keep = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(*by, F.lit("bounded sample")), F.lit(1 << 30)) < keep)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _GOLD)


_BYTE = seeded(256, 1)
_POWER = np.empty(1 << 12, np.uint64)
_POWER[0] = 1
with np.errstate(over="ignore"):
    for _i in range(1, len(_POWER)):
        _POWER[_i] = _POWER[_i - 1] * np.uint64(0xD6E8FEB86659FD93)

#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    WORD[ord(_a) : ord(_b) + 1] = True
WORD[128:] = True
#: Bytes of tokens between white space.
TOKEN = np.ones(256, bool)
TOKEN[:33] = False


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a large_string array, and where each text begins and the last ends."""
    arr = arr if arr.offset == 0 else pa.concat_arrays([arr])
    at = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[at[0] : at[-1]] if buf is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = WORD, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash of every word in reading order, and how many words each text has; with `prefix` also a hash of each word's first bytes.

    Texts of any length: worked on in segments.
    """
    hashes, heads, n = [], [], np.zeros(len(at) - 1, np.int64)
    table = np.where(is_word, _BYTE, np.uint64(0))
    lo = 0
    while lo < len(data):
        hi = min(lo + SEGMENT, len(data))
        while hi < len(data) and is_word[data[hi - 1]] and is_word[data[hi]]:
            hi += 1
        part = data[lo:hi]
        inside = is_word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        first[starts] = inside[starts]
        begin = np.flatnonzero(first)
        if len(begin):
            span = np.diff(np.append(begin, len(part))).astype(np.int32)
            place = np.arange(begin[0], len(part), dtype=np.int32) - np.repeat(begin.astype(np.int32), span)
            place &= len(_POWER) - 1
            terms = table[part[begin[0] :]]
            with np.errstate(over="ignore"):
                terms *= _POWER[place]
                if prefix:
                    head = np.zeros(len(begin), np.uint64)
                    for j in range(prefix):
                        k = begin - begin[0] + j
                        ok = (k < len(terms)) & (j < span)
                        head[ok] += terms[k[ok]]
                    heads.append(mix(head))
                hashes.append(mix(np.add.reduceat(terms, begin - begin[0])))
            n += np.diff(np.searchsorted(begin, at - lo))
        lo = hi
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return (join(hashes), join(heads), n) if prefix else (join(hashes), n)


_PLACE = seeded(64, 7) | np.uint64(1)


def shingle_hashes(words: np.ndarray, n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, text by text; a shorter text with any word has one shingle of all its words."""
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    if not len(words):
        return np.empty(0, np.uint64), n
    first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    begin = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    short = np.repeat(np.where(n_words < width, first + n_words, len(words) + width), n)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    out = np.zeros(len(begin), np.uint64)
    few = bool((n_words < width).any())
    with np.errstate(over="ignore"):
        for j in range(width):
            term = padded[begin + j] * _PLACE[j]
            out += np.where(begin + j < short, term, np.uint64(0)) if few else term
        return mix(out), n


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `budget` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    part = (np.cumsum(size, dtype=np.int64) - size) // budget
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(size)], strict=True):
        yield batch.slice(int(lo), int(hi - lo))
