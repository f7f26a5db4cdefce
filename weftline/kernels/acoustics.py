"""Formants and band energies of short audio frames."""

from __future__ import annotations

import numpy as np

FRAME_S, HOP_S = 0.03, 0.01
EMPHASIS = 0.97
FFT = 2048
#: First three formants of vowels in Hz, weights of their differences, bands in Hz.
VOWELS = {
    "IY": (255, 2330, 3000),
    "IH": (350, 1975, 2560),
    "EH": (560, 1875, 2550),
    "AE": (735, 1625, 2465),
    "AA": (760, 1065, 2550),
    "AO": (610, 865, 2540),
    "UW": (290, 940, 2180),
    "UH": (475, 1070, 2410),
    "AH": (640, 1250, 2610),
}
WEIGHTS = (2, 1, 1)
BANDS = {"sh": (2500, 3000), "s": (3000, 4000), "rest": (300, 2500)}


def frames(signal: np.ndarray, rate: int, length: float = FRAME_S, hop: float = HOP_S) -> list[tuple[float, np.ndarray]]:
    """(start in seconds, samples) of overlapping frames that lie wholly inside the signal."""
    size, step = int(length * rate), int(hop * rate)
    return [(at / rate, signal[at : at + size]) for at in range(0, len(signal) - size, step)]


def prepared(frame: np.ndarray) -> np.ndarray:
    """Pre-emphasis, zero mean, peak of 1."""
    first = 2 * frame[0] - frame[1] if len(frame) > 1 else 0.0
    y = frame - EMPHASIS * np.concatenate([[first], frame[:-1]])
    y = y - y.mean()
    peak = np.abs(y).max()
    return y / peak if peak > 0 else y


def prediction(frame: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients by Burg's recursion on forward and backward errors."""
    a = np.array([1.0])
    forward, backward = frame[1:].astype(float), frame[:-1].astype(float)
    for _ in range(order):
        power = (forward**2).sum() + (backward**2).sum()
        if power <= 0:
            raise ValueError("the frame is silent")
        k = -2.0 * (forward * backward).sum() / power
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        forward, backward = (forward + k * backward)[1:], (backward + k * forward)[:-1]
    return a


def formants(frame: np.ndarray, rate: int, count: int = 3) -> np.ndarray:
    """The lowest resonances in Hz; raises if the frame has too few."""
    roots = np.roots(prediction(prepared(frame), int(2 + rate / 1000)))
    found = np.sort(np.angle(roots[np.imag(roots) >= 0]) * rate / (2 * np.pi))[:count]
    if len(found) < count:
        raise ValueError("too few resonances")
    return found


def nearest_vowel(found: np.ndarray) -> str:
    return min(VOWELS, key=lambda v: float(np.linalg.norm(np.array(WEIGHTS) * (np.array(VOWELS[v]) - found))))


def vowel_track(signal: np.ndarray, rate: int) -> list[tuple[float, str, float, float, float]]:
    """(time, vowel, f1, f2, f3) of each frame; frames without formants are skipped."""
    out = []
    for at, frame in frames(signal, rate):
        try:
            f = formants(frame, rate)
        except (ValueError, np.linalg.LinAlgError):
            continue
        out.append((at, nearest_vowel(f), *(float(x) for x in f)))
    return out


def band_shares(signal: np.ndarray, rate: int, hop: float = HOP_S) -> list[tuple[float, float, float]]:
    """(time, share of sh, share of s) of windows centred on a grid."""
    step, window = int(hop * rate), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT) / FFT)
    padded = np.pad(signal.astype(float), FFT // 2)
    freqs = np.fft.rfftfreq(FFT, 1 / rate)
    masks = {k: (freqs >= lo) & (freqs <= hi) for k, (lo, hi) in BANDS.items()}
    out = []
    for k in range(1 + len(signal) // step):
        spectrum = np.abs(np.fft.rfft(padded[k * step : k * step + FFT] * window))
        energy = {b: float(spectrum[m].sum()) for b, m in masks.items()}
        total = sum(energy.values())
        out.append((k * step / rate, energy["sh"] / total if total > 0 else 0.0, energy["s"] / total if total > 0 else 0.0))
    return out
