"""Numeric kernels in numpy for what has no relational form. None of them knows Spark."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from typing import BinaryIO

import numpy as np


def butterworth(order: int, cutoff_hz: float, rate_hz: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital low-pass: analog poles on a circle, bilinear transform, zeros at -1."""
    warped = 2 * rate_hz * math.tan(math.pi * cutoff_hz / rate_hz)
    sections = []
    for k in range((order + 1) // 2):
        pole = warped * np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
        z = (2 * rate_hz + pole) / (2 * rate_hz - pole)
        if abs(pole.imag) < 1e-9 * warped:
            a, b = np.array([1.0, -z.real, 0.0]), np.array([1.0, 1.0, 0.0])
        else:
            a, b = np.array([1.0, -2 * z.real, abs(z) ** 2]), np.array([1.0, 2.0, 1.0])
        sections.append((b * a.sum() / b.sum(), a))
    return sections


@dataclass(frozen=True)
class System:
    """Sections in a row as one linear system: state' = a state + b in, out = c state + d in."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def steady(self) -> np.ndarray:
        """The state that a constant input of 1 keeps."""
        return np.linalg.solve(np.eye(len(self.a)) - self.a, self.b)


def system(sections: list) -> System:
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for num, den in sections:
        own_a = np.array([[-den[1], 1.0], [-den[2], 0.0]])
        own_b = np.array([num[1] - den[1] * num[0], num[2] - den[2] * num[0]])
        a = np.block([[a, np.zeros((len(a), 2))], [np.outer(own_b, c), own_a]])
        b, c, d = np.concatenate([b, own_b * d]), np.concatenate([num[0] * c, [1.0, 0.0]]), num[0] * d
    return System(a, b, c, d)


#: Samples that a system runs at once by matrices.
WIDTH = 64


def run(how: System, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(out, state after) of the columns of x from a state (a column each). Blocks of WIDTH samples run from an empty state
    by one matrix product; the states between blocks come from a prefix scan that doubles its reach; no loop runs a
    sample."""
    n, columns = x.shape
    size = len(how.a)
    powers = [np.eye(size)]
    for _ in range(WIDTH):
        powers.append(how.a @ powers[-1])
    shown = np.array([how.c @ p for p in powers[:-1]])  # what is left of a state in the t-th output
    pulse = np.concatenate([[how.d], shown[:-1] @ how.b])
    lag = np.subtract.outer(np.arange(WIDTH), np.arange(WIDTH))
    answer = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
    ends = np.array([p @ how.b for p in powers[WIDTH - 1 :: -1]][:WIDTH]).T  # what the t-th input leaves at a block's end
    whole = n // WIDTH
    out = np.empty_like(x, dtype=float)
    if whole:
        blocks = x[: whole * WIDTH].reshape(whole, WIDTH, columns)
        states = np.einsum("st,btc->bsc", ends, blocks)
        states[0] += powers[WIDTH] @ state
        step, leap = 1, powers[WIDTH]
        while step < whole:
            states[step:] = states[step:] + np.einsum("st,btc->bsc", leap, states[:-step])
            step, leap = step * 2, leap @ leap
        starts = np.concatenate([state[None], states[:-1]])
        out[: whole * WIDTH] = (np.einsum("ut,btc->buc", answer, blocks) + np.einsum("ts,bsc->btc", shown, starts)).reshape(-1, columns)
        state = states[-1]
    rest = n - whole * WIDTH
    if rest:
        tail = x[whole * WIDTH :]
        out[whole * WIDTH :] = answer[:rest, :rest] @ tail + shown[:rest] @ state
        state = powers[rest] @ state + ends[:, WIDTH - rest :] @ tail
    return out, state


def scanned(first: np.ndarray, ends: Sequence[np.ndarray], sizes: Sequence[int], how: System) -> list[np.ndarray]:
    """The state before each of some blocks, from the state before the first, the states in which they end if they start
    empty, and their sizes."""
    out = [first]
    for end, n in zip(ends[:-1], sizes[:-1]):
        out.append(np.linalg.matrix_power(how.a, n) @ out[-1] + end)
    return out


def pad_length(order: int) -> int:
    """Samples that zero_phase needs at either end."""
    n = (order + 1) // 2
    return 3 * (2 * n + 1 - order % 2)


def zero_phase(x: np.ndarray, order: int, cutoff_hz: float, rate_hz: float) -> np.ndarray:
    """Forward and backward low-pass of the columns of x, extended by point reflection at both ends."""
    n = pad_length(order)
    if len(x) <= n:
        raise ValueError("signal is too short for the filter")
    how = system(butterworth(order, cutoff_hz, rate_hz))
    longer = np.concatenate([head_pad(x, n), x, tail_pad(x, n)])
    there, _ = run(how, longer, np.outer(how.steady, longer[0]))
    back, _ = run(how, there[::-1], np.outer(how.steady, there[-1]))
    return back[::-1][n:-n]


def head_pad(x: np.ndarray, n: int) -> np.ndarray:
    """The n samples before x, by point reflection at its first."""
    return 2 * x[:1] - x[n:0:-1]


def tail_pad(x: np.ndarray, n: int) -> np.ndarray:
    return 2 * x[-1:] - x[-2 : -n - 2 : -1]


def peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Places of local maxima (the middle of a plateau), `distance` samples apart, with at least this prominence."""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(x)]))
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (starts[top] + ends[top] - 1) // 2
    at = at[apart(at, x[at], distance)]
    return at[x[at] - bases(x, at, (starts[top] + ends[top] - 1) // 2) >= prominence]


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of some places stay if the highest (ties: the last) goes first and removes all that are nearer to it than
    `distance`: removed places leave a linked list, so each is looked at once."""
    n = len(at)
    places, keep = at.tolist(), [True] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in np.argsort(height, kind="stable")[::-1].tolist():
        if not keep[i]:
            continue
        for link, other in ((after, before), (before, after)):
            j = link[i]
            while 0 <= j < n and abs(places[j] - places[i]) < distance:
                keep[j] = False
                j = link[j]
            link[i] = j
            if 0 <= j < n:
                other[j] = i
    return np.array(keep, bool)


def bases(x: np.ndarray, at: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """For each place of `at`, the higher of the lowest values on its two sides, each up to the next higher value or the
    end. tops are all local maxima. A stack of tops that fall holds for each the lowest value since the one before it, so
    every top is pushed and popped once."""
    sides = []
    for values, places in ((x, tops), (x[::-1], len(x) - 1 - tops[::-1])):
        cuts = np.concatenate(([0], places))
        lowest = np.minimum.reduceat(values, cuts)[: len(places)].tolist() if len(places) else []
        stack, found = [(float(values[0]), float(values[0]))], []
        for low, h in zip(lowest, values[places].tolist()):
            while stack and stack[-1][0] <= h:
                low = min(low, stack.pop()[1])
            stack.append((h, low))
            found.append(low)
        sides.append(np.array(found))
    if not len(tops):
        return np.empty(0)
    return np.maximum(sides[0], sides[1][::-1])[np.searchsorted(tops, at)]


def step_peaks(t: np.ndarray, x: np.ndarray, rate_hz: float, min_interval: float, prominence: float) -> np.ndarray:
    """Times of step peaks; gaps take the median of the signal."""
    known = np.isfinite(x)
    if len(x) < 3 or known.sum() < 3:
        return np.empty(0)
    filled = np.where(known, x, np.median(x[known]))
    return t[peaks(filled, max(1, round(min_interval * rate_hz)), prominence)]


def rational(rate_from: int, rate_to: int) -> tuple[int, int]:
    step = Fraction(rate_to, rate_from).limit_denominator(1000)
    return step.numerator, step.denominator


def resampled_length(n: int, rate_from: int, rate_to: int) -> int:
    up, down = rational(rate_from, rate_to)
    return -(-n * up // down)


def needed(lo: int, hi: int, n: int, rate_from: int, rate_to: int) -> tuple[int, int]:
    """The range of n input samples that outputs lo to hi (exclusive) of `polyphase` are made of."""
    up, down = rational(rate_from, rate_to)
    half = 0 if up == down else 10 * max(up, down)
    return min(n, max(0, -(-(lo * down - half) // up))), min(n, ((hi - 1) * down + half) // up + 1)


def polyphase(x: np.ndarray, rate_from: int, rate_to: int, lo: int = 0, hi: int | None = None, at: int = 0) -> np.ndarray:
    """Outputs lo to hi (exclusive; None: all) of a resampling by a rational factor with a windowed sinc. x holds the input
    from sample `at` on, as far as `needed` says; other samples count as silence. All of n inputs give ceil(n * up / down)."""
    up, down = rational(rate_from, rate_to)
    hi = resampled_length(len(x), rate_from, rate_to) if hi is None else hi
    if up == down:
        return x[lo - at : hi - at]
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    centre = np.arange(lo, hi) * down
    out = np.zeros(hi - lo)
    first = -(-(centre - half) // up)
    for j in range(2 * half // up + 1):
        i = first + j
        tap = centre - i * up + half
        ok = (i >= at) & (i < at + len(x)) & (tap >= 0) & (tap <= 2 * half)
        out[ok] += x[i[ok] - at] * taps[tap[ok]]
    return out


@dataclass(frozen=True)
class Wav:
    """What a WAV file's header says: the place and number of its frames, of `channels` samples of `bits`."""

    rate: int
    channels: int
    bits: int
    floats: bool
    at: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.bits // 8 * self.channels


def wav_header(f: BinaryIO, length: int) -> Wav:
    """The header of RIFF chunks: PCM of 8 to 32 bits or floats. The samples aren't read."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt, body = 12, None, None
    while at + 8 <= length and body is None:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            data = f.read(min(size, 40))
            fmt = struct.unpack("<HHIIHH", data[:16])
            if fmt[0] == 0xFFFE:
                fmt = (struct.unpack("<H", data[24:26])[0], *fmt[1:])
        elif name == b"data":
            body = (at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    if fmt is None or body is None:
        raise ValueError("WAVE file without format or data")
    kind, channels, rate, _, _, bits = fmt
    if not channels or not rate or (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError(f"unsupported WAVE encoding {kind} of {bits} bits")
    return Wav(rate, channels, bits, kind == 3, body[0], body[1] // (bits // 8 * channels))


def wav_samples(f: BinaryIO, how: Wav, lo: int, hi: int) -> np.ndarray:
    """Frames lo to hi (exclusive), samples in their own type."""
    f.seek(how.at + lo * how.frame_bytes)
    body = f.read((hi - lo) * how.frame_bytes)
    if how.floats:
        samples = np.frombuffer(body, f"<f{how.bits // 8}")
    elif how.bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24).astype(np.int32)
    else:
        samples = np.frombuffer(body, "u1" if how.bits == 8 else f"<i{how.bits // 8}")
    return samples.reshape(-1, how.channels)


def mono(samples: np.ndarray) -> np.ndarray:
    """Samples as floats in [-1, 1], channels averaged."""
    if samples.dtype.kind == "i":
        info = np.iinfo(samples.dtype)
        out = samples.astype(float) / max(abs(info.min), info.max)
    elif samples.dtype.kind == "u":
        middle = (np.iinfo(samples.dtype).max + 1) / 2
        out = (samples.astype(float) - middle) / middle
    else:
        out = samples.astype(float)
    out = out.mean(axis=1)
    if not np.isfinite(out).all():
        raise ValueError("audio has samples that aren't finite")
    return out
