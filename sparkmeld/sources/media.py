"""Pictures and sounds to feature rows, in batches and in streams: one decode, all features, a status instead of an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import acoustics, raster, shapes, voice
from ..functions.exprs import label_hint, word_and_speaker
from ..operators import scale


def masks(pictures: DataFrame, width: int = 640) -> DataFrame:
    """pictures(file, height, width, gray) -> the same with the mask of the main object as gray: 0 or 255, without loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, h, w, gray = (batch.column(i).to_pylist() for i in range(4))
            out = [raster.piece_mask(np.frombuffer(g, np.uint8).reshape(y, x), width) for y, x, g in zip(h, w, gray, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file, pa.string()), pa.array([m.shape[0] for m in out], pa.int32()), pa.array([m.shape[1] for m in out], pa.int32()), pa.array([(m * np.uint8(255)).tobytes() for m in out], pa.binary())],
                ["file", "height", "width", "gray"],
            )

    return pictures.select("file", "height", "width", "gray").mapInArrow(run, "file string, height int, width int, gray binary")


def _rows(df: DataFrame, schema: T.StructType, kernel: Callable[..., dict | None], missing: str) -> DataFrame:
    """df's rows through a kernel: (file, the schema's columns, status). A row that fails says why and stops nothing."""
    names = schema.names
    full = T.StructType([T.StructField("file", T.StringType()), *schema.fields, T.StructField("status", T.StringType())])
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.float64() for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, found, status = batch.column(0).to_pylist(), [], []
            for values in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)), strict=True):
                try:
                    got = None if any(v is None for v in values) else kernel(*values)
                    found.append(got or {})
                    status.append(missing if got is None else "ok")
                except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
                    found.append({})
                    status.append(f"failed: {type(e).__name__}")
            columns = [pa.array([x.get(n) for x in found], t) for n, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), *columns, pa.array(status, pa.string())], full.names)

    return df.mapInArrow(run, full)


def shape_features(pictures: DataFrame, full: bool = False) -> DataFrame:
    """pictures(file, height, width, gray) -> (file, features, status ok or no_object), if full with label_hint and the size."""
    names = shapes.ALL if full else shapes.PIECE
    kind = lambda n: T.IntegerType() if n in shapes.WHOLE else T.DoubleType()
    size = [T.StructField("orig_width", T.IntegerType()), T.StructField("orig_height", T.IntegerType())] if full else []
    schema = T.StructType([*size, *[T.StructField(n, kind(n)) for n in names]])

    def kernel(h: int, w: int, gray: bytes) -> dict | None:
        got = shapes.features(np.frombuffer(gray, np.uint8).reshape(h, w), full)
        return got and got | {"orig_width": w, "orig_height": h}

    out = _rows(pictures.select("file", "height", "width", "gray"), schema, kernel, "no_object")
    return out.withColumn("label_hint", label_hint(F.col("file"))) if full else out


def word_features(sounds: DataFrame) -> DataFrame:
    """sounds(file, samples) -> (file, zcr_std, rolloff95_std, mfcc_std_4, status ok or unreadable); silence has NaN features."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in acoustics.WORD])
    return _rows(sounds.select("file", "samples"), schema, lambda y: acoustics.word_features(np.array(y)), "unreadable")


_VOICE = "file string, sample_rate int, frame_length int, hop_length int, n_fft int, feature_vector array<double>, feature_names array<string>, status string"


def voice_features(sounds: DataFrame) -> DataFrame:
    """sounds(file, samples) -> (file, label, speaker, the sizes used, feature_vector, feature_names, status ok, unreadable, failed or no_word).

    A sound without a word in its name has its numbers and a null label; an unreadable one has null for all numbers.
    """
    sizes = ("sample_rate", "frame_length", "hop_length", "n_fft")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, status = [], []
            for i in range(batch.num_rows):
                y = batch.column(1)[i]
                try:
                    got = voice.features(y.values.to_numpy(zero_copy_only=False)) if y.is_valid else None
                    rows.append(got or {})
                    status.append("ok" if got else "unreadable")
                except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
                    rows.append({})
                    status.append(f"failed: {type(e).__name__}")
            vectors = [list(r["features"].values()) if r else None for r in rows]
            names = [list(r["features"]) if r else None for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r.get(k) for r in rows], pa.int32()) for k in sizes], pa.array(vectors, pa.list_(pa.float64())), pa.array(names, pa.list_(pa.string())), pa.array(status, pa.string())],
                ["file", *sizes, "feature_vector", "feature_names", "status"],
            )

    word, speaker = word_and_speaker(F.col("file"))
    out = sounds.select("file", "samples").mapInArrow(run, _VOICE).withColumns({"label": word, "speaker": speaker})
    status = F.when((F.col("status") == "ok") & F.col("label").isNull(), "no_word").otherwise(F.col("status"))
    return out.withColumn("status", status).select("file", "label", "speaker", *sizes, "feature_vector", "feature_names", "status")


def with_dataset_scores(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with a z-score of each, the one-row statistics): NaN is left out of the statistics and stays NaN."""
    names = list(acoustics.WORD)
    stats = scale.fit(features, names, skip_nan=True)
    scaled = scale.scaled(features, stats, names, "eps")
    return scaled.withColumnsRenamed({f"z_{n}": f"{n}_z" for n in names}), stats
