"""Audio features in numpy: resampling, spectra, mel filters, log-mel and filter-bank features, joined speech vectors."""

from __future__ import annotations

import numpy as np

# Fixed values of the speech models' input
SAMPLE_RATE = 16_000
FFT, HOP, MELS, FRAMES = 400, 160, 80, 3000
SPEAKER_DIM, PROSODY_DIM = 256, 384
MAX_SAMPLES = 960_000


def resampled(pcm: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Linear interpolation; past the last sample its value goes on."""
    if rate == to or not len(pcm):
        return np.asarray(pcm, np.float32)
    at = np.arange(int(len(pcm) * (to / rate))) / (to / rate)
    return np.interp(at, np.arange(len(pcm)), pcm).astype(np.float32)


def mel_filters(mels: int = MELS, fft: int = FFT, rate: int = SAMPLE_RATE) -> np.ndarray:
    """Triangles between points that are equally far apart on the HTK mel scale, at whole bins: mels x (fft / 2 + 1)."""
    top = 2595.0 * np.log10(1.0 + rate / 2 / 700.0)
    hertz = 700.0 * (10.0 ** (np.linspace(0.0, top, mels + 2) / 2595.0) - 1.0)
    points = np.floor((fft + 1) * hertz / rate).astype(int)
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    k = np.arange(fft // 2 + 1)[None, :]
    rise = (k - low) / np.maximum(mid - low, 1)
    fall = (high - k) / np.maximum(high - mid, 1)
    return np.where((k >= low) & (k < mid), rise, np.where((k >= mid) & (k < high), fall, 0.0))


def _energies(pcm: np.ndarray, frames: int) -> np.ndarray:
    """Logarithms of mel energies, frames x mels; what lies beyond the signal is silence."""
    padded = np.zeros((frames - 1) * HOP + FFT)
    n = min(len(pcm), len(padded))
    padded[:n] = pcm[:n]
    windows = np.lib.stride_tricks.sliding_window_view(padded, FFT)[::HOP]
    power = np.abs(np.fft.rfft(windows * np.hanning(FFT), axis=1)) ** 2
    return np.log10(np.maximum(power @ mel_filters().T, 1e-10))


def log_mel(pcm: np.ndarray) -> np.ndarray:
    """MELS x FRAMES of exactly 30 seconds, not more than 8 below the loudest, scaled."""
    out = _energies(pcm, FRAMES).T
    return ((np.maximum(out, out.max() - 8.0) + 4.0) / 8.0).astype(np.float32)


def filter_bank(pcm: np.ndarray) -> np.ndarray:
    """A row of MELS for every frame of the signal, one at least."""
    return _energies(pcm, (len(pcm) - FFT) // HOP + 1 if len(pcm) >= FFT else 1).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.linalg.norm(v))
    return v / norm if norm > 1e-10 else v


def speech_vector(speaker: np.ndarray, prosody: np.ndarray) -> np.ndarray:
    """The last SPEAKER_DIM values of the speaker model's output and the mean over time of the prosody model's, each of length one."""
    means = prosody.reshape(-1, prosody.shape[-1]).mean(0) if prosody.ndim < 3 else prosody[0].mean(0)
    return np.concatenate([unit(speaker.ravel()[-SPEAKER_DIM:]), unit(means)]).astype(np.float32)


def described(pcm: np.ndarray) -> np.ndarray:
    """A vector without a model: means and deviations of the filter-bank features over time."""
    bank = filter_bank(pcm)
    return unit(np.concatenate([bank.mean(0), bank.std(0)])).astype(np.float32)
