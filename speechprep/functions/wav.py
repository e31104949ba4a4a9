"""WAV bytes <-> samples, and resampling: helpers that run inside tasks."""

from __future__ import annotations

import math
import struct

import numpy as np

PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
# Fixed values of the usual windowed-sinc resampler: zero crossings, roll-off.
ZERO_CROSSINGS, ROLLOFF = 6, 0.99


def write_wav(samples: np.ndarray, rate: int, encoding: str = "float32") -> bytes:
    """One- or two-dimensional (channel, time) samples as a WAV file."""
    data = np.atleast_2d(np.asarray(samples, dtype=np.float32))
    channels = data.shape[0]
    if encoding == "float32":
        kind, body = IEEE_FLOAT, data.T.astype("<f4").tobytes()
    elif encoding == "pcm16":
        scaled = np.rint(np.clip(data.T, -1, 1) * 32767)
        kind, body = PCM, scaled.astype("<i2").tobytes()
    else:
        raise ValueError(f"unknown WAV encoding {encoding!r}")
    width = 4 if kind == IEEE_FLOAT else 2
    form = struct.pack(
        "<4sIHHIIHH", b"fmt ", 16, kind, channels, rate,
        rate * channels * width, channels * width, 8 * width,
    )
    chunks = b"WAVE" + form + struct.pack("<4sI", b"data", len(body)) + body
    return struct.pack("<4sI", b"RIFF", len(chunks)) + chunks


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(channel, time) float32 samples and the sample rate; raises on other input."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    form = body = None
    at = 12
    while at + 8 <= len(content) and body is None:
        name, size = struct.unpack_from("<4sI", content, at)
        if name == b"fmt ":
            form = content[at + 8 : at + 8 + size]
        elif name == b"data":
            body = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("no fmt or data chunk")
    kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", form)
    if kind == EXTENSIBLE:
        (kind,) = struct.unpack_from("<H", form, 24)
    body = body[: len(body) // block * block]
    if kind == IEEE_FLOAT and bits in (32, 64):
        flat = np.frombuffer(body, f"<f{bits // 8}")
    elif kind == PCM and bits == 8:
        flat = (np.frombuffer(body, np.uint8) - 128.0) / 128
    elif kind == PCM and bits in (16, 32):
        flat = np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    elif kind == PCM and bits == 24:
        triples = np.frombuffer(body, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(triples), 4), np.uint8)
        wide[:, 1:] = triples
        flat = wide.reshape(-1).view("<i4") / 2.0**31
    else:
        raise ValueError(f"WAV kind {kind} with {bits} bits")
    return flat.astype(np.float32).reshape(-1, channels).T, rate


def mono(channels: np.ndarray) -> np.ndarray:
    return channels.mean(axis=0, dtype=np.float32)


# Filters made last in this worker, by rate pair; and how many to hold.
_TAPS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
_HELD = 16
# Rates beyond this are taken for damage.
MAX_RATE = 768_000
# Output samples worked on at once.
_BLOCK = 65_536


def _taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The non-zero filter taps of each output phase, the input where they start, and their reach."""
    if (old, new) in _TAPS:
        return _TAPS[old, new]
    cutoff = min(old, new) * ROLLOFF
    reach = math.ceil(ZERO_CROSSINGS * old / cutoff)
    phases = np.arange(new)
    starts = phases * old // new - reach
    inputs = starts[:, None] + np.arange(2 * reach + 2)[None, :]
    t = (inputs / old - phases[:, None] / new) * cutoff
    window = np.where(
        np.abs(t) < ZERO_CROSSINGS, np.cos(np.pi * t / (2 * ZERO_CROSSINGS)) ** 2, 0
    )
    while len(_TAPS) >= _HELD:
        del _TAPS[next(iter(_TAPS))]
    _TAPS[old, new] = np.sinc(t) * window * cutoff / old, starts, reach
    return _TAPS[old, new]


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling; ``ceil(n * target / rate)`` samples come out."""
    if rate == target:
        return samples
    if not 0 < rate <= MAX_RATE:
        raise ValueError(f"sampling rate {rate}")
    common = math.gcd(rate, target)
    old, new = rate // common, target // common
    taps, starts, reach = _taps(old, new)
    width = taps.shape[1]
    n = math.ceil(len(samples) * new / old)
    padded = np.zeros(reach + len(samples) + old + width, np.float64)
    padded[reach : reach + len(samples)] = samples
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    for at in range(0, n, _BLOCK):
        k = np.arange(at, min(n, at + _BLOCK))
        phase = k % new
        here = views[k // new * old + starts[phase] + reach]
        out[at : at + _BLOCK] = np.einsum("ij,ij->i", here, taps[phase])
    return out
