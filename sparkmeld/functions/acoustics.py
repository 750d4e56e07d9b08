"""Features of one mono sound in numpy: silence trim, spectra, mel cepstrum, roll-off, zero crossings."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The three features that words are told by, and what is added to each deviation.
WORD = ("zcr_std", "rolloff95_std", "mfcc_std_4")
EPS = 1e-8
#: Fixed values of the mel scale: linear to 1000 Hz in steps of 200/3, then 27 steps to each factor of 6.4.
MEL_STEP, MEL_KNEE, MEL_LOG = 200 / 3, 1000.0, np.log(6.4) / 27


def frames(y: np.ndarray, size: int, hop: int, border: str = "constant") -> np.ndarray:
    """(frames, size): frames centred on every hop, the signal padded by half a frame at both ends."""
    wide = np.pad(y, size // 2, mode=border)
    return np.lib.stride_tricks.sliding_window_view(wide, size)[::hop]


def resampled(y: np.ndarray, own: int, rate: int, zeros: int = 32, block: int = 1 << 14) -> np.ndarray:
    """y at another rate, by a windowed sinc of `zeros` crossings to a side that lets nothing pass above either rate's half.

    int(len(y) * rate / own) samples; beyond its ends the sound is silence. Working memory is bounded by `block`.
    """
    n, cut = int(len(y) * rate / own), min(1.0, rate / own) * 0.97  # room for the slope of the filter
    if own == rate or not n:
        return y[:n]
    half = int(np.ceil(zeros / cut))
    padded = np.concatenate((np.zeros(half), y, np.zeros(half + 1)))
    out = np.empty(n)
    reach = np.arange(-half + 1, half + 1)
    for lo in range(0, n, block):
        at = np.arange(lo, min(lo + block, n)) * (own / rate)
        first = np.floor(at).astype(np.int64)
        gap = reach[None] - (at - first)[:, None]
        taps = cut * np.sinc(cut * gap) * np.i0(9.0 * np.sqrt(np.maximum(0.0, 1 - (gap / half) ** 2))) / np.i0(9.0)
        out[lo : lo + block] = (padded[first[:, None] + reach[None] + half] * taps).sum(1)
    return out


def trimmed(y: np.ndarray, top_db: float = 30, size: int = 2048, hop: int = 512) -> np.ndarray:
    """The signal from the first to the last frame that is less than top_db below the loudest."""
    if not len(y):
        return y
    loud = np.maximum(np.sqrt((frames(y, size, hop) ** 2).mean(1)), 1e-5)
    on = np.flatnonzero(20 * np.log10(loud / loud.max()) > -top_db)
    return y[on[0] * hop : (on[-1] + 1) * hop] if len(on) else y[:0]


def power(y: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(frames, frequencies): squared magnitude of the spectrum of Hann-weighted frames."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(frames(y, size, hop) * window)) ** 2


@cache
def mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    """(bands, frequencies): triangles of equal area, evenly spaced in mel from 0 to half the rate."""
    knee = MEL_KNEE / MEL_STEP
    top = rate / 2
    top_mel = knee + np.log(top / MEL_KNEE) / MEL_LOG if top >= MEL_KNEE else top / MEL_STEP
    mel = np.linspace(0, top_mel, bands + 2)
    hz = np.where(mel < knee, mel * MEL_STEP, MEL_KNEE * np.exp(MEL_LOG * (mel - knee)))
    f = np.fft.rfftfreq(size, 1 / rate)
    rise, fall = (f - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - f) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def decibels(p: np.ndarray, floor: float = 80) -> np.ndarray:
    db = 10 * np.log10(np.maximum(p, 1e-10))
    return np.maximum(db, db.max() - floor)


def mfcc(y: np.ndarray, rate: int, n: int = 13, size: int = 2048, hop: int = 512, bands: int = 128) -> np.ndarray:
    """(frames, n) mel-frequency cepstral coefficients: an orthonormal cosine transform of log band powers."""
    db = decibels(power(y, size, hop) @ mel_bank(rate, size, bands).T)
    basis = np.cos(np.pi / bands * np.outer(np.arange(n), np.arange(bands) + 0.5)) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return db @ basis.T


def rolloff(p: np.ndarray, rate: int, share: float) -> np.ndarray:
    """By frame, the least frequency up to which a share of the power lies."""
    below = np.cumsum(p, 1)
    return (below >= share * below[:, -1:]).argmax(1) * (rate / 2 / (p.shape[1] - 1))


def crossings(y: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """By frame, the share of samples at which the sign changes; what is next to nothing counts as 0."""
    negative = np.signbit(np.where(np.abs(frames(y, size, hop, "edge")) <= 1e-10, 0.0, frames(y, size, hop, "edge")))
    return (negative[:, 1:] != negative[:, :-1]).sum(1) / size


def word_features(y: np.ndarray, rate: int = 16_000) -> dict[str, float]:
    """WORD of a sound: deviations over frames after trimming and scaling to its peak; NaN for silence, as the peak is 0."""
    y = trimmed(np.asarray(y, float))
    peak = float(np.abs(y).max(initial=0.0))
    if not peak:
        return dict.fromkeys(WORD, float("nan"))
    y = y / peak
    values = (crossings(y), rolloff(power(y, 1024, 256), rate, 0.95), mfcc(y, rate)[:, 3])
    return {k: float(v.std() + EPS) for k, v in zip(WORD, values, strict=True)}
