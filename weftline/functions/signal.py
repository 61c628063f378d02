"""Numeric functions on samples, frames and spectra: expressions where Spark can state them, numpy where order recurs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins that each of the 26 aperiodicity bands fills; they sum to 1025. Fixed values.
BAND_WIDTHS = (2, 3, 4, 4, 4, 5, 5, 6, 6, 7, 8, 9, 10, 12, 14, 16, 19, 24, 29, 37, 49, 68, 99, 160, 300, 125)


# Expressions


def mulaw(x: Column) -> Column:
    """Companded value in -1..1 of a sample in -1..1."""
    return F.signum(x) * F.log1p(255.0 * F.abs(x)) / math.log(256.0)


def mulaw_code(x: Column) -> Column:
    """-127..127, truncated toward zero."""
    return (mulaw(x) * 127.0).cast("int")


def mulaw_code_unsigned(x: Column) -> Column:
    """0..254."""
    return ((mulaw(x) + 1.0) * 127.0).cast("int")


def mulaw_inverse(y: Column) -> Column:
    return F.signum(y) * (F.pow(F.lit(256.0), F.abs(y)) - 1.0) / 255.0


def from_code(code: Column) -> Column:
    return mulaw_inverse(code / 127.0)


def from_code_unsigned(code: Column) -> Column:
    """Divides by 128 as the discrete decoder does, so it is not the exact inverse of mulaw_code_unsigned."""
    return mulaw_inverse(code / 128.0 - 1.0)


def hann(n: int) -> Column:
    """Array of n weights 0.5 * (1 - cos(2 pi (k + 1) / (n + 1)))."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: 0.5 * (1.0 - F.cos(2 * math.pi * (k + 1) / (n + 1))))


def hamming(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: 0.54 - 0.46 * F.cos(2 * math.pi * k / (n - 1)))


def expand_bands(bands: Column, widths: tuple[int, ...] = BAND_WIDTHS) -> Column:
    """Every band's value repeated over its bins."""
    counts = F.array(*map(F.lit, widths))
    return F.flatten(F.zip_with(bands, counts, lambda v, w: F.array_repeat(v, w)))


def safe_reciprocal(x: Column, most: float = 1e38) -> Column:
    """1 / x, bounded: +-most at zero and beyond, zero at +-infinity."""
    return F.when(F.abs(x) <= 1.0 / most, F.when(x >= 0, most).otherwise(-most)).when(F.abs(x) >= most, 0.0).otherwise(1.0 / F.nullif(x, F.lit(0.0)))


def gaussian(x: Column, mean: Column | float, sigma: Column | float) -> Column:
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2.0 * sigma * sigma if isinstance(sigma, float) else F.lit(2.0) * sigma * sigma))


def scalar_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def transpose(rows: Column) -> Column:
    """Transpose an array of equally long arrays."""
    width = F.size(F.element_at(rows, 1))
    return F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))).otherwise(rows)


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two matrices given as arrays of rows."""
    return F.transform(a, lambda row: F.transform(transpose(b), lambda column: scalar_product(row, column)))


def test_tone(seconds: Column, hertz: float) -> Column:
    return F.sin(2 * math.pi * hertz * seconds)


def noise(seed: int = 1234) -> Column:
    return F.randn(seed)


def pick(probabilities: Column, at: Column) -> Column:
    """Index of the first element at which the running sum passes `at`: a draw by inverse distribution, at uniform in 0..1."""
    running = F.aggregate(probabilities, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, p: F.struct((s["sum"] + p).alias("sum"), (s["n"] + (s["sum"] + p <= at).cast("int")).alias("n")), lambda s: s["n"])
    return F.least(running, F.size(probabilities) - 1)


# Arrays


@lru_cache(maxsize=32)
def _twiddles(n: int) -> np.ndarray:
    return np.exp(-2j * np.pi * np.arange(n // 2) / n)


def fft(x: np.ndarray) -> np.ndarray:
    """Radix-2 transform along the last axis; its length must be a power of two."""
    x = np.asarray(x, complex)
    n = x.shape[-1]
    if n & (n - 1) or not n:
        raise ValueError("length is not a power of two")
    if n == 1:
        return x
    even, odd = fft(x[..., ::2]), fft(x[..., 1::2]) * _twiddles(n)
    return np.concatenate((even + odd, even - odd), -1)


def ifft(x: np.ndarray) -> np.ndarray:
    return np.conj(fft(np.conj(x))) / np.shape(x)[-1]


def magnitude(x: np.ndarray) -> np.ndarray:
    return np.abs(fft(x))


def windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping windows of x, padded with one window of zeros in front; whole hops only."""
    padded = np.concatenate((np.zeros(size), x))
    n = (len(padded) - size) // hop
    return np.stack([padded[i * hop : i * hop + size] for i in range(n)]) if n > 0 else np.empty((0, size))


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Transforms of Hamming-weighted windows: size // 2 + 1 bins each."""
    return fft(windows(x, size, hop) * np.hamming(size))[:, : size // 2 + 1]


def log_spectrum(x: np.ndarray, size: int, hop: int, floor: float = -3.0, normalise: bool = False) -> np.ndarray:
    out = np.maximum(np.log10(np.maximum(np.abs(stft(x, size, hop)), 1e-12)), floor)
    if normalise and len(out):
        sd = out.std(0)
        out = (out - out.mean(0)) / np.where(sd == 0, 1, sd)
    return out


def overlap_add(frames: np.ndarray, hop: int) -> np.ndarray:
    """Samples of inverse-transformed half spectra, weighted by the window and normalised by its energy."""
    size = 2 * (frames.shape[1] - 1)
    full = np.concatenate((frames, np.conj(frames[:, -2:0:-1])), 1)
    parts, window = ifft(full).real, np.hamming(size)
    out, weight = np.zeros(hop * (len(frames) - 1) + size), np.zeros(hop * (len(frames) - 1) + size)
    for i, part in enumerate(parts):
        out[i * hop : i * hop + size] += part * window
        weight[i * hop : i * hop + size] += window**2
    return (out / np.maximum(weight, 1e-8))[size:]


def griffin_lim(magnitudes: np.ndarray, hop: int, rounds: int = 30) -> np.ndarray:
    """Samples whose spectrogram has nearly the given magnitudes, by repeated projection."""
    size = 2 * (magnitudes.shape[1] - 1)
    spectrum = magnitudes.astype(complex)
    for _ in range(rounds):
        x = overlap_add(spectrum, hop)
        again = stft(x, size, hop)
        phase = np.ones_like(spectrum)
        phase[: len(again)] = again[: len(phase)] / np.maximum(np.abs(again[: len(phase)]), 1e-8)
        spectrum = magnitudes * phase
    return overlap_add(spectrum, hop)


def best_offset(a: np.ndarray, b: np.ndarray) -> int:
    """Shift of b that correlates it best with a."""
    return int(np.argmax(np.correlate(np.asarray(a) - np.mean(a), np.asarray(b) - np.mean(b), "full"))) - (len(b) - 1)


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y[n] = (sum b[k] x[n-k] - sum over k > 0 of a[k] y[n-k]) / a[0]."""
    b, a, x = (np.asarray(v, float) for v in (b, a, x))
    forward, out = np.convolve(b, x)[: len(x)] / a[0], np.zeros(len(x))
    tail = a[1:] / a[0]
    for n in range(len(x)):
        k = min(n, len(tail))
        out[n] = forward[n] - (tail[:k] @ out[n - k : n][::-1] if k else 0.0)
    return out


def fir_by_transform(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    size = 1 << max(0, math.ceil(math.log2(len(b) + len(x) - 1)))
    padded = lambda v: np.concatenate((np.asarray(v, float), np.zeros(size - len(v))))
    return ifft(fft(padded(b)) * fft(padded(x))).real[: len(x)]


def butterworth(order: int, cut: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digital low- or high-pass coefficients (b, a) by the bilinear transform; cut is a share of the Nyquist frequency."""
    warped = 2 * np.tan(np.pi * cut / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if high:
        poles = warped**2 / poles
    z = (2 + poles) / (2 - poles)
    a = np.poly(z).real
    b = np.poly(np.full(order, 1.0 if high else -1.0)).real
    at = -1.0 if high else 1.0
    gain = np.polyval(a, at) / np.polyval(b, at)
    return b * gain, a


def interpolate(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation, NaN outside; x must rise strictly."""
    x = np.asarray(x, float)
    if np.any(np.diff(x) <= 0):
        raise ValueError("x doesn't rise strictly")
    return np.interp(at, x, y, left=np.nan, right=np.nan)


def solve_inverse(m: np.ndarray) -> np.ndarray:
    """Inverse by elimination with partial pivoting (LAPACK)."""
    return np.linalg.inv(np.asarray(m, float))


def multiply_polynomials(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.convolve(a, b)


def centre_zero(x: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(x)


def sigmoid_scale(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Rescale to low..high by a logistic curve."""
    return low + (high - low) / (1 + np.exp(-np.asarray(x, float)))


def fractional_shift_phase(n: int, shift: float) -> np.ndarray:
    """Phase factors that delay a signal of n samples by a fraction of a sample."""
    return np.exp(-2j * np.pi * np.fft.fftfreq(n) * shift)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling."""
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x) if len(x) else np.empty(0)


# Mel-cepstra


def to_filter(mc: np.ndarray, alpha: float) -> np.ndarray:
    """Filter coefficients of a mel-cepstrum: b[m] = c[m] - alpha * b[m + 1]."""
    b = np.array(mc, float)
    for m in range(len(b) - 2, -1, -1):
        b[m] = mc[m] - alpha * b[m + 1]
    return b


def from_filter(b: np.ndarray, alpha: float) -> np.ndarray:
    out = np.array(b, float)
    out[:-1] += alpha * np.asarray(b, float)[1:]
    return out


def warp_frequency(c: np.ndarray, order: int, alpha: float) -> np.ndarray:
    """A cepstrum on another frequency scale, by the first-order all-pass recursion; further axes are cepstra side by side."""
    c = np.asarray(c, float)
    g = np.zeros((order + 1, *c.shape[1:]))
    for value in c[::-1]:
        d = g.copy()
        g[0] = value + alpha * d[0]
        if order >= 1:
            g[1] = (1 - alpha**2) * d[0] + alpha * d[1]
        for j in range(2, order + 1):
            g[j] = d[j - 1] + alpha * (d[j] - g[j - 1])
    return g


def impulse_response(c: np.ndarray, n: int) -> np.ndarray:
    """Minimum-phase impulse response of a cepstrum."""
    h = np.zeros(n)
    h[0] = math.exp(c[0])
    for i in range(1, n):
        k = np.arange(1, min(i, len(c) - 1) + 1)
        h[i] = (k * np.asarray(c)[k] * h[i - k]).sum() / i
    return h


def energy(b: np.ndarray, alpha: float, n: int = 576) -> float:
    """Energy of the filter's impulse response."""
    return float((impulse_response(warp_frequency(from_filter(b, alpha), n - 1, -alpha), n) ** 2).sum())


def spectrum(mc: np.ndarray, alpha: float = 0.55, size: int = 2048) -> np.ndarray:
    """Amplitude spectrum, size // 2 + 1 bins, of a mel-cepstrum."""
    c = warp_frequency(mc, size // 2, -alpha)
    padded = np.zeros(size)
    padded[: len(c)] = c
    return np.exp(fft(padded)[: size // 2 + 1].real)


def gain_normalise(c: np.ndarray, gamma: float) -> np.ndarray:
    """Generalised cepstrum with the gain as its first coefficient."""
    c = np.asarray(c, float)
    if gamma == 0:
        return np.concatenate(([np.exp(c[0])], c[1:]))
    z = 1 + gamma * c[0]
    return np.concatenate(([z ** (1 / gamma)], c[1:] / z))


def gain_restore(c: np.ndarray, gamma: float) -> np.ndarray:
    c = np.asarray(c, float)
    if gamma == 0:
        return np.concatenate(([np.log(c[0])], c[1:]))
    z = c[0] ** gamma
    return np.concatenate(([(z - 1) / gamma], c[1:] * z))


def change_gamma(c: np.ndarray, gamma: float, order: int, to: float) -> np.ndarray:
    """Gain-normalised generalised cepstrum for another gamma."""
    c = np.asarray(c, float)
    out = np.zeros((order + 1, *c.shape[1:]))
    out[0] = c[0]
    for m in range(1, order + 1):
        k = np.arange(1, m)
        inside = k[(k < len(c)) & (m - k <= order)]
        left = np.array([kk * c[kk] * out[m - kk] for kk in inside])
        other = np.array([kk * out[kk] * c[m - kk] for kk in k if m - kk < len(c)])
        out[m] = (c[m] if m < len(c) else 0.0) + (to * left.sum(0) - gamma * other.sum(0)) / m
    return out


def convert(c: np.ndarray, alpha: float, gamma: float, order: int, to_alpha: float, to_gamma: float) -> np.ndarray:
    """Mel-generalised cepstrum on another frequency scale and for another gamma."""
    warped = warp_frequency(c, order, (to_alpha - alpha) / (1 - alpha * to_alpha))
    return gain_restore(change_gamma(gain_normalise(warped, gamma), gamma, order, to_gamma), to_gamma)


def _product(p: np.ndarray, factor: list) -> np.ndarray:
    """Polynomials times a short one; coefficients are on the first axis."""
    out = np.zeros((len(p) + len(factor) - 1, *p.shape[1:]))
    for i, x in enumerate(factor):
        out[i : i + len(p)] += x * p
    return out


def line_spectrum_to_lpc(lsp: np.ndarray) -> np.ndarray:
    """Prediction polynomial of line spectral frequencies in radians, ascending; further axes are spectra side by side."""
    lsp = np.asarray(lsp, float)
    p = q = np.ones((1, *lsp.shape[1:]))
    for w in lsp[::2]:
        p = _product(p, [1, -2 * np.cos(w), 1])
    for w in lsp[1::2]:
        q = _product(q, [1, -2 * np.cos(w), 1])
    p, q = (_product(p, [1, 1]), _product(q, [1, -1])) if len(lsp) % 2 == 0 else (p, _product(q, [1, 0, -1]))
    return ((p + q) / 2)[: len(lsp) + 1]


def line_spectrum_to_cepstrum(lsp: np.ndarray, stages: int = 1, alpha: float = 0.0, log_gain: bool = False) -> np.ndarray:
    """Mel-generalised cepstrum, gamma = -1 / stages, of a gain (its logarithm with log_gain) and line spectral frequencies.

    The filter is gain / polynomial ** stages, and (1 + gamma * C) ** (1 / gamma) of the result. Further axes of lsp are
    spectra side by side.
    """
    lsp, gamma = np.asarray(lsp, float), -1 / stages
    gain = np.exp(lsp[0]) if log_gain else lsp[0]
    c = gain_restore(np.concatenate(([gain], line_spectrum_to_lpc(lsp[1:])[1:])), gamma)
    c[1:] /= gamma
    return convert(c, alpha, gamma, len(c) - 1, alpha, gamma)


class StagedFilter:
    """1 / B ** stages for B = 1 + b[1] * w + ... + b[m] * w ** m, where w is a delay on a frequency scale warped by alpha.

    The stages stand one behind the other, and each keeps its delays, so coefficients can change from sample to sample.
    With a shape it is as many filters side by side, and samples and coefficients have its axes last.
    """

    def __init__(self, order: int, alpha: float, stages: int, shape: tuple[int, ...] = ()) -> None:
        self.alpha, self.delays = alpha, np.zeros((stages, order + 1, *shape))

    def step(self, x: float | np.ndarray, b: np.ndarray) -> float | np.ndarray:
        """One sample; b[0] isn't looked at."""
        a, order = self.alpha, self.delays.shape[1] - 1
        for d in self.delays:
            for i in range(1, order):
                d[i] += a * (d[i + 1] - d[i - 1])
            x = x - (d[:order] * b[1 : order + 1]).sum(0)
            first = a * d[0] + (1 - a * a) * x
            d[1:] = d[:-1].copy()
            d[0] = first
        return x


def staged_filter(x: np.ndarray, frames: np.ndarray, hop: int, stages: int, alpha: float = 0.0) -> np.ndarray:
    """Samples through a StagedFilter whose coefficients are those of one frame for `hop` samples each, the last frame's to the end.

    frames are mel-generalised cepstra with gamma = -1 / stages; each scales its samples by its gain. Axes beyond frames and
    coefficients are filters side by side, with a result of their own each.
    """
    held = StagedFilter(frames.shape[1] - 1, alpha, stages, frames.shape[2:])
    gamma = -1 / stages
    gains = [gain_normalise(to_filter(c, alpha), gamma) for c in frames]
    return np.array([held.step(v * gains[k][0], gamma * gains[k]) for i, v in enumerate(x) for k in [min(i // hop, len(frames) - 1)]])


#: Coefficients of the fifth-order rational approximation of exp that the synthesis filter uses. Fixed values.
PADE = (1.0, 0.4999391, 0.1107098, 0.01369984, 0.0009564853, 0.00003041721)


class SynthesisFilter:
    """exp of a mel-cepstral filter, sample by sample: stages for the first coefficient and for the rest, each a Padé ladder.

    With a shape it is as many filters side by side, and samples and coefficients have its axes last.
    """

    def __init__(self, order: int, alpha: float, shape: tuple[int, ...] = ()) -> None:
        self.order, self.alpha = order, alpha
        self.first = np.zeros((len(PADE), 2, *shape))
        self.rest = np.zeros((len(PADE), *shape))
        self.delay = np.zeros((order + 2, len(PADE) - 1, *shape))

    def _ladder(self, x: float | np.ndarray, outputs: np.ndarray) -> float | np.ndarray:
        total, feed = 0.0, 0.0
        for i in range(len(PADE) - 1, 0, -1):
            v = outputs[i - 1] * PADE[i]
            feed = feed + v if i % 2 else feed - v
            total = total + v
        self._fed = x + feed
        return total + self._fed

    def step(self, x: float | np.ndarray, b: np.ndarray) -> float | np.ndarray:
        a, aa = self.alpha, 1 - self.alpha**2
        self.first[1:, 1] = aa * self.first[:-1, 0] + a * self.first[1:, 1]
        out = self.first[1:, 1] * b[1]
        x = self._ladder(x, out)
        self.first[1:, 0] = out
        self.first[0, 0] = self._fed
        out = self._tails(self.rest[:-1], b)
        x = self._ladder(x, out)
        self.rest[1:] = out
        self.rest[0] = self._fed
        return x

    def _tails(self, x: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All stages but the first: none needs what another makes of this sample."""
        a, d = self.alpha, self.delay
        d[0] = x
        d[1] = (1 - a**2) * d[0] + a * d[1]
        y = np.zeros_like(x)
        for k in range(2, self.order + 1):
            d[k] += a * (d[k + 1] - d[k - 1])
            y += d[k] * b[k]
        d[2:] = d[1:-1].copy()
        return y

    def keep(self, n: int) -> None:
        """Go on with the first n filters only."""
        self.first, self.rest, self.delay = (v[..., :n].copy() for v in (self.first, self.rest, self.delay))


def vocode(mc: np.ndarray, f0: np.ndarray, rate: int = 16_000, alpha: float = 0.42, seed: int = 1) -> np.ndarray:
    """Samples of mel-cepstral frames: pulses at the pitch or, where it is 0, noise, through the synthesis filter."""
    return next(vocode_in_turn([mc], [f0], rate, alpha, seed))[1]


def vocode_in_turn(mcs: list[np.ndarray], f0s: list[np.ndarray], rate: int = 16_000, alpha: float = 0.42, seed: int = 1, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    """Index and samples, as vocode makes them, of each utterance, the longest first; about `most` samples are made and held at a time, by filters side by side."""
    lengths = np.array([len(mc) for mc in mcs], int)
    order, at = np.argsort(-lengths, kind="stable").tolist(), 0
    while at < len(order):
        of = order[at : at + max(1, most // max(1, rate // 200 * int(lengths[order[at]])))]
        at += len(of)
        yield from zip(of, _vocode_beside([mcs[i] for i in of], [f0s[i] for i in of], rate, alpha, seed), strict=True)


def _vocode_beside(mcs: list[np.ndarray], f0s: list[np.ndarray], rate: int, alpha: float, seed: int) -> list[np.ndarray]:
    """The samples of each utterance, the longest first: each sample is one step for all that last so long."""
    hop, lengths = rate // 200, np.array([len(mc) for mc in mcs])
    frames, width = int(lengths[0]), len(mcs)
    b, f0 = np.zeros((frames + 1, np.shape(mcs[0])[1], width)), np.zeros((frames, width))
    for i, (mc, pitch) in enumerate(zip(mcs, f0s, strict=True)):
        if len(mc):
            b[: len(mc), :, i], b[len(mc), :, i], f0[: len(mc), i] = mc, mc[-1], pitch
    b = to_filter(b.swapaxes(0, 1), alpha).swapaxes(0, 1)
    voiced = f0 > 0
    unvoiced = np.cumsum(~voiced, 0) - ~voiced
    # Each utterance draws its own noise from the seed, so all draw the same.
    noise = np.random.default_rng(seed).uniform(-1, 1, hop * frames)
    filt, out, phase = SynthesisFilter(b.shape[1] - 1, alpha, (width,)), np.zeros((hop * frames, width)), np.ones(width)
    for t in range(frames):
        n = int(np.searchsorted(-lengths, -t))
        if n < len(phase):
            filt.keep(n)
            phase = phase[:n]
        here, after, on = b[t, :, :n], b[t + 1, :, :n], voiced[t, :n]
        pitch = np.where(on, f0[t, :n], 1.0)
        rise, pulse, drawn = pitch / rate, np.sqrt(rate / pitch), unvoiced[t, :n] * hop
        for i in range(hop):
            c = here + (after - here) * i / hop
            phase = np.where(on, phase + rise, 1.0)
            struck = on & (phase >= 1)
            x = np.where(on, np.where(struck, pulse, 0.0), noise[drawn + i])
            phase = phase - struck
            out[t * hop + i, :n] = filt.step(x * np.exp(c[0]), c)
    return [out[: hop * n, i] for i, n in enumerate(lengths)]


# Smoothing, post-filtering, splicing


def smooth_voiced(x: np.ndarray, passes: int = 3) -> np.ndarray:
    """Each non-zero value becomes the mean of itself and its neighbours if both are non-zero; in place, left to right."""
    out = np.array(x, float)
    for _ in range(passes):
        for i in range(1, len(out) - 1):
            if out[i - 1] and out[i] and out[i + 1]:
                out[i] = (out[i - 1] + out[i] + out[i + 1]) / 3
    return out


def smooth_joint(frames: np.ndarray, joint: int, reach: int = 2) -> np.ndarray:
    """Frames around a joint of units drawn linearly from the last frame left of the reach to the first right of it."""
    out = np.array(frames, float)
    low, high = max(joint - reach, 0), min(joint + reach, len(out) - 1)
    for i in range(low + 1, high):
        out[i] = out[low] + (out[high] - out[low]) * (i - low) / (high - low)
    return out


def splice(samples: np.ndarray, natural: np.ndarray, frame: int, per_frame: int = 240) -> np.ndarray:
    """Natural samples put over synthetic ones from a frame on, faded over one frame at both ends."""
    out, at = np.array(samples, float), frame * per_frame
    n = min(len(natural), len(out) - at)
    if n <= 0:
        return out
    weight = np.minimum(1.0, np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / per_frame)
    out[at : at + n] = (1 - weight) * out[at : at + n] + weight * natural[:n]
    return out


def postfilter(mc: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Stress formants: coefficients from the third on times 1 + beta, with the energy kept."""
    b = to_filter(mc, alpha)
    before = energy(b, alpha)
    sharper = np.array(mc, float)
    sharper[2:] *= 1 + beta
    b = to_filter(sharper, alpha)
    b[0] += math.log(before / energy(b, alpha)) / 2
    return from_filter(b, alpha)


def pulse_from_magnitudes(magnitudes: np.ndarray, n: int) -> np.ndarray:
    """One pitch period of n samples with the given harmonic magnitudes (1 beyond them), its peak at the start."""
    full = np.ones(n)
    full[0] = 0.0
    k = min(len(magnitudes), (n - 1) // 2)
    full[1 : k + 1] = magnitudes[:k]
    full[n - k :] = magnitudes[:k][::-1]
    return np.fft.ifft(full).real * n / math.sqrt(n)


def circular_shift(x: np.ndarray, by: int) -> np.ndarray:
    return np.roll(x, by)


def mean_power(x: np.ndarray) -> float:
    return float(np.mean(np.square(x))) if len(x) else 0.0
