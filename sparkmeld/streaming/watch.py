"""From folders of new files to answers: files are classified batch by batch into an event table, commands ask about its last images.

Files must appear whole (written elsewhere and renamed). Files that lie there at the start are in the first batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import CLASSES
from ..operators import bayes
from ..sources.files import IMAGE_GLOB
from .log import commands

EVENT = "key string, event_id long, ts timestamp, kind string, value string"
BINARY = "path string, modificationTime timestamp, length long, content binary"
PICTURE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
EXIT = "salir"


def new_sounds(spark: SparkSession, folder: str, pattern: str = "*.wav", at_once: int = 1000) -> DataFrame:
    """A stream of binary files, at most `at_once` to a batch; the rest comes with the next."""
    return spark.readStream.schema(BINARY).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder)


def new_pictures(spark: SparkSession, folder: str, pattern: str = IMAGE_GLOB, at_once: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, image) of picture files of every extension; unreadable ones are left out."""
    rows = spark.readStream.schema(PICTURE).format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"), "image")


def into_table(files: DataFrame, classify: Callable[[DataFrame], DataFrame], kind: str, folder: str, checkpoint: str, key: str = "all") -> StreamingQuery:
    """files(path, modificationTime, ...) through classify(batch) -> (file, value) into the event table; null values are left out.

    A batch that is run again after a failure writes nothing if its rows are already there.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{folder}/{kind}-{number}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return
        times = batch.select(F.col("path").alias("file"), F.col("modificationTime").alias("ts"))
        rows = classify(batch).where("value is not null").select("file", F.lower("value").alias("value")).join(times, "file")
        rows.select(F.lit(key).alias("key"), F.xxhash64("file", "ts").alias("event_id"), "ts", F.lit(kind).alias("kind"), "value").write.mode("overwrite").parquet(path)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table that into_table() fills, as a stream."""
    return spark.readStream.schema(EVENT).parquet(f"{folder}/*-*")


def answers(asked: DataFrame, total: int = 1000) -> DataFrame:
    """asked(key, event_id, command, classes) -> (key, event_id, command, status, sample_counts, proportions, expected), arrays in class order.

    status: ok, exit, no_sample (no image in the sample), unknown_class (the sample holds another label) or unknown_command.
    Only an ok row has proportions and expected counts.
    """
    known = F.array(*[F.lit(c) for c in CLASSES])
    counts = F.array(*[(F.size("classes") - F.size(F.array_remove("classes", c))).cast("long") for c in CLASSES])
    status = (
        F.when(F.col("command") == EXIT, "exit").when(~F.col("command").isin("proporcion", "contar"), "unknown_command").when(F.size("classes") == 0, "no_sample")
        .when(F.size(F.array_except("classes", known)) > 0, "unknown_class").otherwise("ok")
    )
    rows = asked.withColumns({"sample_counts": counts, "status": status})
    pairs = rows.where("status = 'ok'").select("event_id", F.explode(F.arrays_zip(known.alias("class"), F.col("sample_counts").alias("n"))).alias("x")).select("event_id", "x.class", "x.n")
    shares = bayes.proportions(bayes.posterior(pairs, "event_id"), "event_id")
    both = shares.join(bayes.expected_counts(shares, "event_id", total), ["event_id", "class"]).groupBy("event_id")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("class_no", c))), lambda x: x[c])
    return rows.join(both.agg(ordered("proportion").alias("proportions"), ordered("expected").alias("expected")), "event_id", "left").select(
        "key", "event_id", "command", "status", "sample_counts", "proportions", "expected"
    )


def serve(events: DataFrame, respond: Callable[[DataFrame], None], checkpoint: str, patience: float | None = None) -> bool:
    """Answer the commands of an event stream batch by batch until one is the exit; False if `patience` seconds pass first.

    The exit ends the loop whether or not there is a sample.
    """
    ended: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            respond(answers(batch))
            if not batch.where(F.col("command") == EXIT).isEmpty():
                ended.append(number)
        finally:
            batch.unpersist()

    query = commands(events).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").start()
    waited = 0.0
    try:
        while not ended and (patience is None or waited < patience):
            if query.awaitTermination(1):
                break
            waited += 1
    finally:
        query.stop()
    return bool(ended)
