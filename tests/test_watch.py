import os
import wave

import numpy as np
from pyspark.sql import functions as F

from sparkmeld.functions.exprs import CLASSES
from sparkmeld.sources import files
from sparkmeld.streaming import watch


def put(folder, name, when):
    x = (np.sin(np.arange(1600) / 5) * 20000).astype(np.int16)
    with wave.open(str(folder / name), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(x.tobytes())
    os.utime(folder / name, (when, when))


def test_answers(spark):
    c = dict(zip("taun", ("tornillo", "arandela", "tuerca", "clavo"), strict=True))
    rows = [("k", 1, "contar", [c["t"]] * 3 + [c["n"]] * 3 + [c["a"]] * 2 + [c["u"]] * 2), ("k", 2, "salir", []), ("k", 3, "proporcion", []), ("k", 4, "contar", ["desconocido"]), ("k", 5, "hola", [c["t"]])]
    got = {r.event_id: r for r in watch.answers(spark.createDataFrame(rows, "key string, event_id long, command string, classes array<string>")).collect()}
    assert [got[i].status for i in range(1, 6)] == ["ok", "exit", "no_sample", "unknown_class", "unknown_command"]
    # fixed values: the estimate of a sample of 3 tornillo, 3 clavo, 2 arandela, 2 tuerca
    want = {"tornillo": 229, "clavo": 300, "arandela": 261, "tuerca": 210}
    assert dict(zip(CLASSES, got[1].expected, strict=True)) == want and sum(got[1].sample_counts) == 10
    assert abs(sum(got[1].proportions) - 1) < 1e-9 and got[2].expected is None


def test_folder_to_answer(spark, tmp_path):
    pictures, sounds = tmp_path / "pictures", tmp_path / "sounds"
    pictures.mkdir(), sounds.mkdir()
    for i in range(12):  # any file with a name will do for a picture here
        put(pictures, f"{CLASSES[i % 4]}_{i:02d}.wav", 1_700_000_000 + i)
    (pictures / "broken_1.wav").write_bytes(b"no sound")
    put(sounds, "contar_ana_1.wav", 1_700_000_100)
    put(sounds, "salir_ana_2.wav", 1_700_000_200)

    def named(batch):
        return files.decoded_sounds(batch).select("file", F.when(F.col("status") == "ok", F.regexp_extract("stem", "^[a-z]+", 0)).alias("value"))

    table = str(tmp_path / "events")
    for kind, folder in (("image", pictures), ("audio", sounds)):
        q = watch.into_table(watch.new_sounds(spark, str(folder)), named, kind, table, str(tmp_path / f"ck-{kind}"))
        q.processAllAvailable()
        q.stop()
    seen = []
    assert watch.serve(watch.event_stream(spark, table), lambda df: seen.extend(df.collect()), str(tmp_path / "ck-serve"), 120)
    got = {r.command: r for r in seen}
    last = [CLASSES[i % 4] for i in range(2, 12)]
    assert got["contar"].status == "ok" and list(got["contar"].sample_counts) == [last.count(c) for c in CLASSES] and sum(got["contar"].expected) == 1000
    assert got["salir"].status == "exit" and len(seen) == 2
