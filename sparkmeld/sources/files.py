"""Readers of feature records, images and sounds, and writers of results."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.acoustics import resampled
from ..functions.exprs import stem, word_before_underscore

IMAGE_GLOB = "*.{png,PNG,jpg,JPG,jpeg,JPEG,bmp,BMP,tif,TIF,tiff,TIFF}"


def feature_records(spark: SparkSession, folder: str, features: Sequence[str], mode: str = "lenient", skip: Sequence[str] = ("mu_sd.json",)) -> DataFrame:
    """One row per JSON file: file, the features as doubles, status (ok, invalid_json, missing_feature).

    lenient drops what is not ok, strict fails on broken JSON, report keeps every file with its status.
    """
    schema = T.StructType([*[T.StructField(f, T.DoubleType()) for f in features], T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.option("mode", "FAILFAST" if mode == "strict" else "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_name")).where(~F.col("file").isin(list(skip)))
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull()
    rows = rows.withColumn("status", F.when(F.col("_corrupt").isNotNull(), "invalid_json").when(missing, "missing_feature").otherwise("ok")).drop("_corrupt")
    return rows if mode == "report" else rows.where("status = 'ok'")


def images(spark: SparkSession, folder: str, pattern: str = IMAGE_GLOB) -> DataFrame:
    """(file, height, width, gray): decoded images as one byte per pixel; unreadable files are left out."""
    return decoded_images(spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder))


def decoded_images(rows: DataFrame) -> DataFrame:
    """Rows of the image source, of a table or a stream, to (file, height, width, gray)."""

    def gray(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                g = x[:, :, 0] if c == 1 else 0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]
                out.append(np.rint(g).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["file", "height", "width", "gray"])

    flat = rows.select(F.col("image.origin").alias("file"), "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInArrow(gray, "file string, height int, width int, gray binary")


def sounds(spark: SparkSession, folder: str, pattern: str = "*.wav", rate: int = 16_000) -> DataFrame:
    """(file, stem, samples array<double>, status): 16-bit or 8-bit PCM as mono at `rate`; broken files have a status, not an error."""
    return decoded_sounds(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), rate)


def decoded_sounds(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """files(path, content), of a table or a stream, to (file, stem, samples, status)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, status = [], []
            for content in batch.column(1).to_pylist():
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        width, own = w.getsampwidth(), w.getframerate()
                        x = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16}[width]).astype(float)
                        x = ((x - 128) / 128 if width == 1 else x / 32768).reshape(-1, w.getnchannels()).mean(1)
                    x = resampled(x, own, rate)
                    samples.append(x)
                    status.append("ok" if len(x) else "empty")
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    samples.append(None)
                    status.append(f"unreadable: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(samples, pa.list_(pa.float64())), pa.array(status)], ["file", "samples", "status"])

    return files.select("path", "content").mapInArrow(decode, "file string, samples array<double>, status string").withColumn("stem", stem(F.col("file")))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir, or (unset, on a local master) under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what reads it several times plans and computes it once, and lost executors lose nothing."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_records(df: DataFrame, folder: str, key: str = "stem") -> None:
    """A folder of JSON lines for each value of the key; records that share one are together in it."""
    df.write.mode("overwrite").partitionBy(key).json(folder)


def write_statistics(stats: DataFrame, count: int, names: Sequence[str], folder: str) -> None:
    """One row of a scaler's statistics as JSON: z_score_stats.{name}.{mean, std}, count."""
    each = [F.struct(F.col(f"mu_{n}").alias("mean"), (F.col(f"sd_{n}") + 1e-8).alias("std")).alias(n) for n in names]
    stats.select(F.struct(*each).alias("z_score_stats"), F.lit(count).alias("count")).coalesce(1).write.mode("overwrite").json(folder)


def combinations_csv(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of a subset search as text: size, accuracy to six places, indices with spaces, names with bars between."""
    places = F.transform("features", lambda f: (F.array_position(F.array(*[F.lit(n) for n in names]), f) - 1).cast("string"))
    return found.select("size", F.format_string("%.6f", "accuracy").alias("accuracy"), F.array_join(places, " ").alias("indices"), F.array_join("features", "|").alias("names"))


def write_csv(df: DataFrame, folder: str) -> None:
    """All rows, in as many files as there are partitions, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(folder)


def pool_json(ranked: DataFrame, names: Sequence[str], top: int = 18) -> DataFrame:
    """ranked(feature, f) -> one row: topk, indices, names and F_scores of the best, as lists."""
    best = ranked.orderBy(F.desc("f"), F.desc("feature")).limit(top).agg(F.sort_array(F.collect_list(F.struct("f", "feature")), asc=False).alias("b"))
    return best.select(F.size("b").alias("topk"), F.col("b.feature").alias("indices"), F.transform("b.feature", lambda i: F.get(F.array(*[F.lit(n) for n in names]), i)).alias("names"), F.col("b.f").alias("F_scores"))


def perfect_sets(found: DataFrame) -> DataFrame:
    """One row: the perfect subsets' names by size, as a map."""
    per = found.where("perfect").groupBy(F.col("size").cast("string").alias("k")).agg(F.sort_array(F.collect_list("features")).alias("sets"))
    return per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "sets")))).alias("perfect"))


def search_summary(found: DataFrame, score: str = "purity", least: float = 1 - 1e-4) -> DataFrame:
    """One row: counts and best score of a search, and the list of its successes."""
    kept = F.collect_list(F.when(F.col(score) >= least, F.struct(*[c for c in found.columns])))
    return found.agg(F.struct(F.count(F.lit(1)).alias("total_checked"), F.max(score).alias(f"best_{score}"), F.min("size").alias("min_subset_size"), F.max("size").alias("max_subset_size")).alias("summary"), F.sort_array(kept).alias("results"))


def write_json(df: DataFrame, folder: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(folder)


def plot_rows(features: DataFrame, names: Sequence[str], path: str = "file") -> DataFrame:
    """(word, x, y, z): three features ready to be drawn, with the word before the first underscore of the name."""
    return features.dropna(subset=list(names)).select(word_before_underscore(F.col(path)).alias("word"), *[F.col(n).alias(a) for n, a in zip(names, "xyz", strict=True)])


def write_ranked_csv(df: DataFrame, folder: str, *order: str) -> None:
    """A small ranked result as one CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_model(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_model(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
