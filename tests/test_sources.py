import json
import wave
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sparkmeld.functions.acoustics import resampled
from sparkmeld.sources import files
from sparkmeld.streaming import log


def test_feature_records(spark, tmp_path):
    for name, text in {"a.json": '{"f": 1.5, "g": 2}', "b.json": '{"f": 1.5}', "c.json": "{broken", "mu_sd.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    got = {r.file: r.status for r in files.feature_records(spark, str(tmp_path), ["f", "g"], "report").collect()}
    assert got == {"a.json": "ok", "b.json": "missing_feature", "c.json": "invalid_json"}
    assert files.feature_records(spark, str(tmp_path), ["f", "g"]).count() == 1


def test_sounds(spark, tmp_path):
    x = (np.sin(np.arange(1600) / 5) * 20000).astype(np.int16)
    with wave.open(str(tmp_path / "tone.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(x.tobytes())
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    got = {r.stem: r for r in files.sounds(spark, str(tmp_path)).collect()}
    assert got["tone"].status == "ok" and np.allclose(got["tone"].samples, x / 32768)
    assert got["bad"].status.startswith("unreadable") and got["bad"].samples is None


def test_resampled():
    tone = lambda f, rate, seconds=0.25: np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)
    for own in (8_000, 22_050, 44_100, 48_000):
        got = resampled(tone(1_000, own), own, 16_000)
        want = tone(1_000, 16_000)
        assert abs(len(got) - len(want)) <= 1
        n = min(len(got), len(want))
        assert np.abs(got[:n] - want[:n])[200:-200].max() < 2e-3  # the ends are next to silence
    assert np.abs(resampled(tone(10_000, 44_100), 44_100, 16_000))[200:-200].max() < 1e-3  # nothing folds back
    assert np.array_equal(resampled(tone(440, 16_000), 16_000, 16_000), tone(440, 16_000))
    assert len(resampled(np.zeros(0), 44_100, 16_000)) == 0 and len(resampled(np.ones(1), 44_100, 16_000)) == 0


def test_stream_is_batch(spark, tmp_path):
    start, rows = datetime(2024, 1, 1), []
    for i in range(90):
        rows.append(("u", i, start + timedelta(seconds=i), "audio" if i % 7 == 6 else "image", "contar" if i % 7 == 6 else f"c{i % 4}"))
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, kind string, value string")
    for part in range(3):  # files in the order of time
        df.where(F.floor(F.col("event_id") / 30) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = log.commands(stream).writeStream.format("memory").queryName("commands").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: list(r.classes) for r in spark.sql("select * from commands").collect()}
    want = {i: [v for _, _, _, k, v in rows[max(0, i - 10) : i] if k == "image"] for i in range(90) if i % 7 == 6}
    assert got == want
    assert json.dumps(sorted(got)) == json.dumps(sorted(want))
