import math

import numpy as np
import pytest

from sparkmeld.functions import acoustics, raster, shapes, voice
from sparkmeld.sources import media

Y, X = np.mgrid[:200, :220]
DISC = (X - 100) ** 2 + (Y - 90) ** 2 <= 60**2
RING = DISC & ((X - 100) ** 2 + (Y - 90) ** 2 >= 30**2)
RECT = (X >= 40) & (X < 140) & (Y >= 50) & (Y < 110)


def gray(mask):
    return (mask * 255).astype(np.uint8)


def test_disc_and_rectangle():
    disc, rect = shapes.features(gray(DISC), True), shapes.features(gray(RECT), True)
    assert set(disc) == set(shapes.ALL) and len(shapes.ALL) == 77
    assert disc["circle_area_ratio"] == pytest.approx(1, abs=0.03) and disc["circle_radius"] == pytest.approx(60)
    assert rect["angles_min"] == pytest.approx(90) and rect["polygon_vertices"] == 4 and rect["area"] == 99 * 59
    assert rect["min_rect_area_ratio"] == pytest.approx(1) and rect["distance_hist_bin_5"] == 4
    assert "curvature_max" not in rect and shapes.features(gray(RECT))["curvature_max"] == 0
    assert shapes.features(gray(RING), True)["holes_count"] == 1
    assert shapes.features(np.zeros((5, 5), np.uint8)) is None


def test_moments_of_a_square():
    m = shapes.moments(np.array([(0, 0), (0, 2), (2, 2), (2, 0)]))
    assert m[0, 0] == pytest.approx(4) and m[1, 0] == pytest.approx(0) and m[2, 0] == pytest.approx(4 / 3) and m[1, 1] == pytest.approx(0)
    assert shapes.hu_invariants(m)[0] == pytest.approx(1 / 6)


def test_features_do_not_turn():
    shape = RECT | DISC
    a, b = shapes.features(gray(shape)), shapes.features(gray(np.rot90(shape)))
    for k in ("circle_area_ratio", "hu_moment_1", "hu_moment_2", "curvature_max"):
        assert a[k] == pytest.approx(b[k], abs=1e-6)


def test_components_against_flooding():
    rng = np.random.default_rng(1)
    for eight in (True, False):
        mask = rng.random((30, 40)) < 0.5
        got, seen = raster.components(mask, eight), np.zeros(mask.shape, int)
        steps = raster.RING if eight else raster.RING[::2]
        n = 0
        for start in zip(*np.nonzero(mask), strict=True):
            if not seen[start]:
                n, todo = n + 1, [start]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 30 and 0 <= x < 40 and mask[y, x] and not seen[y, x]:
                        seen[y, x] = n
                        todo += [(y + a, x + b) for a, b in steps]
        assert got.max() == n and len(set(zip(got[mask].tolist(), seen[mask].tolist(), strict=True))) == n


def test_outline_of_every_kind():
    one = np.zeros((5, 5), bool)
    one[2, 2] = True
    assert raster.outline(one).tolist() == [[2, 2]] and len(raster.outline(~one & one)) == 0
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert sorted(raster.outline(line).tolist()) == [[1, 2], [7, 2]]
    assert raster.area(raster.outline(RECT)) == 99 * 59


def test_masks_of_photos(spark):
    photo = np.where(DISC, 40, 200).astype(np.uint8)
    df = spark.createDataFrame([("a/tuerca1.png", 200, 220, bytearray(photo.tobytes())), ("b.png", 3, 3, bytearray(9))], "file string, height int, width int, gray binary")
    got = {r.file: r for r in media.shape_features(media.masks(df)).collect()}
    assert got["a/tuerca1.png"].status == "ok" and got["a/tuerca1.png"].circle_area_ratio == pytest.approx(1, abs=0.06)
    full = {r.file: r for r in media.shape_features(df, full=True).collect()}
    assert full["a/tuerca1.png"].label_hint == "tuerca" and full["a/tuerca1.png"].orig_width == 220
    assert full["b.png"].status == "no_object" and full["b.png"].area is None


def test_word_features(spark):
    rate, f = 16_000, 440
    t = np.arange(rate) / rate
    tone = np.sin(2 * math.pi * f * t)
    assert np.median(acoustics.crossings(tone)) == pytest.approx(2 * f / rate, rel=0.05)
    assert np.median(acoustics.rolloff(acoustics.power(tone, 1024, 256), rate, 0.95)) == pytest.approx(f, abs=rate / 1024 * 2)
    quiet = np.concatenate((np.zeros(8000), tone, np.zeros(8000)))
    assert rate <= len(acoustics.trimmed(quiet)) < rate + 4096
    sweep = np.sin(2 * math.pi * (200 + 1500 * t) * t)
    df = spark.createDataFrame([("tone.wav", tone.tolist()), ("sweep.wav", sweep.tolist()), ("silent.wav", [0.0] * 4000), ("bad.wav", None)], "file string, samples array<double>")
    rows, _ = media.with_dataset_scores(media.word_features(df).where("status = 'ok'"))
    got = {r.file: r for r in rows.collect()}
    assert got["sweep.wav"].zcr_std > got["tone.wav"].zcr_std and math.isnan(got["silent.wav"].mfcc_std_4)
    assert got["sweep.wav"].zcr_std_z == pytest.approx(1, abs=1e-3) and got["tone.wav"].zcr_std_z == pytest.approx(-1, abs=1e-3)
    assert media.word_features(df).where("file = 'bad.wav'").first().status == "unreadable"


def test_voice_vector(spark):
    rate = 16_000
    t = np.arange(2 * rate) / rate
    tone = np.sin(2 * math.pi * 220 * t) + 0.5 * np.sin(2 * math.pi * 440 * t)
    sounds = [("d/Contar_Ana_01.wav", tone.tolist()), ("salir_2.WAV", [0.0] * 5000), ("9.wav", [1.0] * 300), ("bad_a_1.wav", None), ("empty_a_1.wav", []), ("nan_a_1.wav", [float("nan")] * 9)]
    got = {r.file: r for r in media.voice_features(spark.createDataFrame(sounds, "file string, samples array<double>")).collect()}
    r = got["d/Contar_Ana_01.wav"]
    f = dict(zip(r.feature_names, r.feature_vector, strict=True))
    assert (r.label, r.speaker, r.hop_length, r.n_fft, r.status, len(f)) == ("contar", "ana", 100, 2048, "ok", 286)
    assert [r.feature_names[i] for i in (68, 214, 213, 242, 66)] == ["mfcc_dd_std_4", "zcr_std", "zcr_mean", "onset_strength_median", "mfcc_dd_std_2"]
    assert f["f0_yin_median"] == pytest.approx(220, rel=0.01) and f["chroma_mean_10"] == max(f[f"chroma_mean_{k}"] for k in range(1, 13))
    assert f["duration_s"] == pytest.approx(2) and f["lpc_mean_0"] == 1
    assert (got["salir_2.WAV"].label, got["salir_2.WAV"].speaker, got["9.wav"].status) == ("salir", None, "no_word")
    assert all(np.isfinite(got[k].feature_vector).all() for k in ("salir_2.WAV", "9.wav"))
    assert {got[k].status for k in ("bad_a_1.wav", "empty_a_1.wav", "nan_a_1.wav")} == {"unreadable"}


def test_tuning():
    """A sound a third of a semitone sharp has the notes that it has when tuned."""
    rate = 16_000
    t = np.arange(2 * rate) / rate
    play = lambda off: sum(np.sin(2 * math.pi * f * 2 ** (off / 12) * t) for f in (440, 554.365, 659.255))
    found = [voice.tuning(acoustics.power(play(off), 2048, 100), rate, 2048) for off in (0, 0.33, -0.25)]
    assert found == pytest.approx([0, 0.33, -0.25], abs=0.05)
    tuned, sharp = (voice.features(play(off))["features"] for off in (0, 0.33))
    assert [sharp[f"chroma_mean_{k}"] for k in range(1, 13)] == pytest.approx([tuned[f"chroma_mean_{k}"] for k in range(1, 13)], abs=0.15)
    assert [sharp[f"tonnetz_mean_{k}"] for k in range(1, 7)] == pytest.approx([tuned[f"tonnetz_mean_{k}"] for k in range(1, 7)], abs=0.05)
    assert voice.tuning(np.zeros((3, 1025)), rate, 2048) == 0


def test_voice_kernels():
    rate = 16_000
    clicks = np.zeros(8 * rate)
    clicks[::8000] = 1
    clicks = np.convolve(clicks, np.hanning(64))
    f = voice.features(clicks)["features"]
    assert f["tempo_bpm"] == pytest.approx(120, rel=0.02) and 13 <= f["n_beats"] <= 16
    x = np.random.default_rng(1).standard_normal(40_000)
    for i in range(2, len(x)):
        x[i] += 1.2 * x[i - 1] - 0.8 * x[i - 2]
    flat = x.copy()  # pre-emphasis turns it into x
    for i in range(1, len(x)):
        flat[i] += 0.97 * flat[i - 1]
    a = voice.prediction(flat, 400, 100, order=2).mean(0)
    assert a == pytest.approx([1, -1.2, 0.8], abs=0.05)
    assert voice.slopes(np.arange(20.0)[None] ** 2, 2) == pytest.approx(np.full((1, 20), 2.0))
    notes = np.zeros((12, 1))
    notes[0] = 2
    assert voice.tonal_centroids(notes)[:, 0] == pytest.approx([0, 1, 0, 1, 0, 0.5])
