"""The 286 numbers of a spoken word: cepstra, spectral shape, rhythm, pitch, harmony and linear prediction, pooled over time.

Every kernel works on one mono sound and on all of its frames at once. Notes are tuned as the sound itself is, by its
deviation from A = 440 Hz.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import acoustics as ac

RATE, TRIM_DB, BANDS, COEFFICIENTS, ORDER = 16_000, 40, 40, 13, 16
FRAME, SHORTEST, HARMONIC_FROM = 400, 1024, 8192
#: Names of the five numbers of a series.
POOLED = ("mean", "std", "p10", "p90", "median")
#: Fixed values of the tonal centroids: angle by semitone in units of pi, and radius, for fifths, minor and major thirds.
TONAL = ((7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5))
SMALL = np.finfo(float).tiny
C1, BLOCK = 440 * 2 ** (-45 / 12), 256


def spectrum_size(n: int) -> int:
    """The largest power of two from 64 to 2048 that n samples hold."""
    return min(2048, 1 << (n.bit_length() - 1)) if n >= 64 else max(32, n)


def slopes(x: np.ndarray, order: int, width: int = 9) -> np.ndarray:
    """x(rows, frames): the derivative of that order of polynomials of that order, fitted to `width` frames around each."""
    t = np.arange(width) - width // 2
    weights = np.linalg.pinv(np.vander(t, order + 1, increasing=True))[order] * order  # order! is order for 1 and 2
    inner = np.lib.stride_tricks.sliding_window_view(x, width, axis=1) @ weights
    return np.pad(inner, ((0, 0), (width // 2, width // 2)), mode="edge")


def contrast(mag: np.ndarray, rate: int, lowest: float = 200.0, bands: int = 6, share: float = 0.02) -> np.ndarray:
    """(bands + 1, frames): decibels between the strongest and the weakest `share` of each octave band."""
    f = np.linspace(0, rate / 2, mag.shape[1])
    edges = [0.0, *(lowest * 2.0 ** np.arange(bands + 1))]
    out = []
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = np.flatnonzero((f >= low) & (f <= high))
        first = max(inside[0] - (k > 0), 0)
        stop = len(f) if k == bands else inside[-1] + 1
        n = max(1, int(np.rint(share * (stop - first))))
        ranked = np.sort(mag[:, first : max(stop - (k < bands), first + 1)], axis=1)
        out.append((ranked[:, -n:].mean(1), ranked[:, :n].mean(1)))
    peak, valley = (ac.decibels(np.array(x)) for x in zip(*out, strict=True))
    return peak - valley


def shape(mag: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """By frame: where the spectrum is centred, how wide, where 85 % of it ends, how flat it is."""
    f = np.linspace(0, rate / 2, mag.shape[1])
    part = mag / np.maximum(mag.sum(1, keepdims=True), SMALL)
    centre = part @ f
    wide = np.sqrt((part * (f - centre[:, None]) ** 2).sum(1))
    strong = np.maximum(mag**2, 1e-10)
    return {"centroid": centre, "bandwidth": wide, "rolloff85": ac.rolloff(mag, rate, 0.85), "flatness": np.exp(np.log(strong).mean(1)) / strong.mean(1)}


def onset(bands: np.ndarray, hop: int, size: int = 2048) -> np.ndarray:
    """By frame, the mean rise over bands(bands, frames) in decibels, moved by half a spectrum."""
    rise = np.maximum(np.diff(bands, axis=1), 0).mean(0)
    return np.pad(rise, (1 + size // (2 * hop), 0))[: bands.shape[1]]


def tempo(strength: np.ndarray, rate: int, hop: int, start: float = 120.0, fastest: float = 320.0) -> float:
    """Beats a minute with the strongest mean autocorrelation over 8 s windows, weighted towards `start`."""
    if not strength.any():
        return 0.0
    lags = int(8 * rate / hop)
    wide = np.pad(strength, lags // 2, mode="linear_ramp", end_values=0)
    views = np.lib.stride_tricks.sliding_window_view(wide, lags)[: len(strength)]
    window, total = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(lags) / lags), np.zeros(lags)
    for lo in range(0, len(views), BLOCK):  # long sounds by blocks of frames
        spec = np.abs(np.fft.rfft(views[lo : lo + BLOCK] * window, 2 * lags)) ** 2
        own = np.fft.irfft(spec)[:, :lags]
        total += (own / np.maximum(np.abs(own).max(1, keepdims=True), SMALL)).sum(0)
    speed = 60 * rate / hop / np.arange(1, lags)
    prior = np.where(speed <= fastest, -0.5 * np.log2(speed / start) ** 2, -np.inf)
    return float(speed[(np.log1p(1e6 * np.maximum(total[1:], 0) / len(views)) + prior).argmax()])


def beats(strength: np.ndarray, bpm: float, rate: int, hop: int, tight: float = 100.0) -> np.ndarray:
    """Frames of the beats: the path of strong onsets whose distances keep closest to the tempo."""
    if not bpm or len(strength) < 2 or not strength.any():
        return np.empty(0, np.int64)
    period = max(1, round(60 * rate / hop / bpm))
    bump = np.exp(-0.5 * (np.arange(-period, period + 1) * 32 / period) ** 2)
    local = np.convolve(strength / max(strength.std(ddof=1), SMALL), bump)[period : period + len(strength)]
    back = np.arange(max(1, round(period / 2)), 2 * period + 1)
    cost = tight * np.log(back / period) ** 2
    best, came, begun = np.zeros(len(local)), np.full(len(local), -1), False
    for i, own in enumerate(local):
        reach = back[back <= i]
        score = np.concatenate((best[i - reach], np.zeros(len(back) - len(reach)))) - cost
        at = score.argmax()
        best[i] = own + score[at]
        begun = begun or own >= 0.01 * local.max()
        if begun and at < len(reach):
            came[i] = i - reach[at]
    tops = np.flatnonzero((best > np.append(-np.inf, best[:-1])) & (best >= np.append(best[1:], -np.inf)))
    good = tops[best[tops] > 0.5 * np.median(best[tops])] if len(tops) else tops
    path = [int(good[-1])] if len(good) else []
    while path and came[path[-1]] >= 0:
        path.append(int(came[path[-1]]))
    found = np.array(path[::-1], np.int64)
    smooth = np.convolve(local[found], np.hanning(5), "same") if len(found) > 4 else local[found]
    strong = np.flatnonzero(smooth > 0.5 * np.sqrt((smooth**2).mean())) if len(found) else found
    return found[strong[0] : strong[-1] + 1] if len(strong) else found[:0]


def pitch(y: np.ndarray, rate: int, size: int, hop: int, low: float = 80, high: float = 400, trough: float = 0.1) -> np.ndarray:
    """By frame, the fundamental frequency: the first deep trough of the normalised difference function, between samples."""
    half = size // 2
    first, last = max(int(rate / high), 1), min(int(np.ceil(rate / low)), size - half - 1)
    x = ac.frames(y, size, hop)
    head = x[:, :half]
    cross = np.fft.irfft(np.fft.rfft(x, 2 * size) * np.conj(np.fft.rfft(head, 2 * size)))[:, : last + 1]
    energy = np.cumsum(np.pad(x**2, ((0, 0), (1, 0))), axis=1)
    moved = energy[:, half : half + last + 1] - energy[:, : last + 1]
    differ = np.maximum(moved[:, :1] + moved - 2 * cross, 0)
    mean = np.cumsum(differ[:, 1:], axis=1) / np.arange(1, last + 1)
    d = differ[:, first:] / np.maximum(mean[:, first - 1 :], 1e-12)
    dip = np.zeros(d.shape, bool)
    dip[:, 1:-1] = (d[:, 1:-1] < d[:, :-2]) & (d[:, 1:-1] <= d[:, 2:]) & (d[:, 1:-1] < trough)
    dip[:, 0] = (d[:, 0] < d[:, 1]) & (d[:, 0] < trough)
    at = np.where(dip.any(1), dip.argmax(1), d.argmin(1))
    inner = np.clip(at, 1, d.shape[1] - 2)
    before, here, after = (np.take_along_axis(d, (inner + s)[:, None], 1)[:, 0] for s in (-1, 0, 1))
    bend = before + after - 2 * here
    shift = np.where((inner == at) & (np.abs(bend) > np.abs(after - before) / 2), (before - after) / (2 * np.where(bend == 0, 1, bend)), 0)
    return rate / (first + at + shift)


def tuning(power: np.ndarray, rate: int, size: int, low: float = 150, high: float = 4000, share: float = 0.1) -> float:
    """The commonest deviation of the stronger peaks of power(frames, frequencies) from A = 440 Hz: semitones from -0.5 on, in hundredths; 0 without a peak."""
    mag = np.sqrt(power)
    left, here, right = mag[:, :-2], mag[:, 1:-1], mag[:, 2:]
    f = np.arange(1, mag.shape[1] - 1) * rate / size
    row, col = np.nonzero((here > left) & (here >= right) & (here > share * mag.max(1, keepdims=True)) & (f >= low) & (f < high))
    if not len(row):
        return 0.0
    a, b, c = left[row, col], here[row, col], right[row, col]
    bend = 2 * b - a - c
    exact = (col + 1 + 0.5 * (c - a) / np.where(bend > SMALL, bend, 1)) * rate / size
    off = (12 * np.log2(exact / 440) + 0.5) % 1 - 0.5
    n, edges = np.histogram(off[b >= np.median(b)], bins=100, range=(-0.5, 0.5))
    return round(float(edges[n.argmax()]), 2)


@lru_cache(32)
def note_bank(rate: int, size: int, tune: float = 0.0) -> np.ndarray:
    """(12, frequencies): how much a frequency belongs to each semitone from C, most around the fifth octave."""
    place = 12 * np.log2(np.arange(1, size // 2 + 1) * rate / size / 27.5) - tune  # semitones above the lowest A
    place = np.concatenate(([place[0] - 18], place))
    wide = np.maximum(np.append(np.diff(place), 1), 1)
    off = (place - np.arange(12)[:, None] + 6) % 12 - 6
    bank = np.exp(-0.5 * (2 * off / wide) ** 2)
    bank /= np.maximum(np.sqrt((bank**2).sum(0)), SMALL)
    return np.roll(bank * np.exp(-0.5 * ((place / 12 - 5) / 2) ** 2), -3, axis=0)


def peaked(x: np.ndarray) -> np.ndarray:
    """Columns divided by their largest value."""
    top = x.max(0, initial=0.0, keepdims=True)
    return x / np.where(top > SMALL, top, 1)


def harmonic(y: np.ndarray, size: int = 2048, hop: int = 512, width: int = 31) -> np.ndarray:
    """The sound's steady part: medians along time against medians along frequency as a soft mask."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    spec = np.fft.rfft(ac.frames(y, size, hop) * window)
    mag, half = np.abs(spec), width // 2

    def median(axis: int) -> np.ndarray:
        wide = np.pad(mag, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        views = np.lib.stride_tricks.sliding_window_view(wide, width, axis=axis)
        return np.concatenate([np.median(views[lo : lo + BLOCK], axis=-1) for lo in range(0, len(views), BLOCK)])

    steady, brief = median(0) ** 2, median(1) ** 2
    part = np.fft.irfft(spec * (steady / np.maximum(steady + brief, SMALL)), size) * window
    out, weight = np.zeros(len(part) * hop + size), np.zeros(len(part) * hop + size)
    for i, frame in enumerate(part):
        out[i * hop : i * hop + size] += frame
        weight[i * hop : i * hop + size] += window**2
    return (out / np.where(weight > 1e-8, weight, 1))[size // 2 : size // 2 + len(y)]


def constant_q_notes(y: np.ndarray, rate: int, hop: int, octaves: int = 7, parts: int = 36, tune: float = 0.0) -> np.ndarray:
    """(12, frames): magnitude by semitone from C of filters of equal relative width, `parts` to an octave from C1, `tune` semitones off."""
    q, n, lowest = 1 / (2 ** (1 / parts) - 1), len(y), C1 * 2 ** (tune / 12)
    longest = int(np.ceil(q * rate / lowest))
    size = 1 << (n + longest).bit_length()
    spec, out = np.fft.fft(y, size), np.zeros((12, 1 + n // hop))
    for k in range(octaves * parts):
        f = lowest * 2 ** (k / parts)
        t = np.arange(int(np.ceil(q * rate / f))) - int(np.ceil(q * rate / f)) // 2
        kernel = (0.5 + 0.5 * np.cos(2 * np.pi * t / len(t))) * np.exp(2j * np.pi * f / rate * t)
        kernel /= np.abs(kernel).sum()
        got = np.abs(np.fft.ifft(spec * np.fft.fft(np.pad(kernel, (0, size - len(t)))))) * np.sqrt(len(t))
        own = got[-t[0] : -t[0] + n + 1 : hop][: out.shape[1]]
        out[round(k * 12 / parts) % 12, : len(own)] += own
    return peaked(out)


def tonal_centroids(notes: np.ndarray) -> np.ndarray:
    """(6, frames): notes(12, frames) on the circles of fifths, minor thirds and major thirds."""
    share = notes / np.maximum(np.abs(notes).sum(0, keepdims=True), SMALL)
    turn = np.array([f(np.pi * angle * np.arange(12)) * r for angle, r in TONAL for f in (np.sin, np.cos)])
    return turn @ share


def prediction(y: np.ndarray, size: int, hop: int, order: int = ORDER, quiet: float = 1e-3) -> np.ndarray:
    """(frames, order + 1): linear prediction by Burg's method of pre-emphasised frames that are not quiet; one row of 0 if all are."""
    sharp = y - 0.97 * np.concatenate(([0.0], y[:-1]))
    sharp[0] = 3 * y[0] - y[1]  # as if the sound went on straight before its start
    x = np.lib.stride_tricks.sliding_window_view(sharp, size)[::hop] * np.hanning(size)
    x = x[np.abs(x).max(1) >= quiet]
    if not len(x):
        return np.zeros((1, order + 1))
    a = np.zeros((len(x), order + 1))
    a[:, 0] = 1
    ahead, behind = x[:, 1:], x[:, :-1]
    for i in range(order):
        mirror = -2 * (ahead * behind).sum(1, keepdims=True) / np.maximum((ahead**2 + behind**2).sum(1, keepdims=True), SMALL)
        a[:, : i + 2] += mirror * a[:, i + 1 :: -1]
        ahead, behind = (ahead + mirror * behind)[:, 1:], (behind + mirror * ahead)[:, :-1]
    return a


def features(y: np.ndarray, rate: int = RATE) -> dict | None:
    """Name -> number in the vector's order under `features`, and the sizes used; None for a sound without samples or with values that are not finite."""
    y = ac.trimmed(np.asarray(y, float), TRIM_DB)
    if not len(y) or not np.isfinite(y).all():
        return None
    y = y / max(np.abs(y).max(), SMALL)
    seconds = len(y) / rate
    y = np.pad(y, (0, max(0, SHORTEST - len(y))))
    hop, size = FRAME // 4, spectrum_size(len(y))
    power = ac.power(y, size, hop)
    mag = np.sqrt(power)
    logs = ac.decibels(power @ ac.mel_bank(rate, size, BANDS).T).T
    cepstra = cepstrum(logs)
    cepstra = (cepstra - cepstra.mean(1, keepdims=True)) / (cepstra.std(1, keepdims=True) + 1e-8)
    strength = onset(logs, hop)
    bpm = tempo(strength, rate, hop)
    tonal = np.zeros((6, 1))
    if len(y) >= HARMONIC_FROM:
        steady = harmonic(y)
        tonal = tonal_centroids(constant_q_notes(steady, rate, hop, tune=tuning(ac.power(steady, size, hop), rate, size)))
    out: dict[str, float] = {}
    for name, rows in (
        ("mfcc", cepstra), ("mfcc_d", slopes(cepstra, 1)), ("mfcc_dd", slopes(cepstra, 2)), ("mel_log", logs),
        ("contrast", contrast(mag, rate)), ("chroma", peaked(note_bank(rate, size, tuning(power, rate, size)) @ power.T)), ("tonnetz", tonal),
    ):
        for what, values in (("mean", rows.mean(1)), ("std", rows.std(1))):
            out |= {f"{name}_{what}_{k + 1}": float(v) for k, v in enumerate(values)}
    loud = np.sqrt((ac.frames(y, FRAME, hop) ** 2).mean(1))
    series = {"rms": loud, "zcr": ac.crossings(y, FRAME, hop), **shape(mag, rate), "onset_strength": strength, "f0_yin": pitch(y, rate, FRAME, hop)}
    for name, x in series.items():
        x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
        low, high = np.percentile(x, [10, 90])
        out |= {f"{name}_{p}": float(v) for p, v in zip(POOLED, (x.mean(), x.std(), low, high, np.median(x)), strict=True)}
    out |= {"tempo_bpm": bpm, "n_beats": float(len(beats(strength, bpm, rate, hop)))}
    a = prediction(y, FRAME, hop)
    for what, values in (("mean", a.mean(0)), ("std", a.std(0))):
        out |= {f"lpc_{what}_{k}": float(v) for k, v in enumerate(values)}
    out |= {"duration_s": seconds, "n_frames": float(1 + (len(y) - FRAME) // hop)}
    return {"features": out, "sample_rate": rate, "frame_length": FRAME, "hop_length": hop, "n_fft": size}


def cepstrum(logs: np.ndarray, n: int = COEFFICIENTS) -> np.ndarray:
    """(n, frames): orthonormal cosine transform of logs(bands, frames)."""
    bands = len(logs)
    basis = np.cos(np.pi / bands * np.outer(np.arange(n), np.arange(bands) + 0.5)) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return basis @ logs
