"""Linear filters over recordings of any length: rational resampling and overlap-save filtering, chunk by chunk.

A sample is the value at a whole index, its time times the rate. Indices are cut into chunks of a fixed number; a sample goes to every chunk
whose results it reaches (the halo), so a task holds one chunk and its halo, whatever the length of a channel. Chunks start at fixed indices
and each is computed in one fixed order, so results don't depend on partitions. Indices without a sample, and those beyond a channel's ends, count as zero; of
several samples at one index the greatest counts; null and non-finite amplitudes take no part.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results of a chunk, and the products that are held at once.
CHUNK, PRODUCTS = 16_384, 1 << 21
#: Zero crossings of the resampling filter on either side, and its cut as a part of the lower rate's half.
CROSSINGS, ROLLOFF = 32, 0.9
_OUT = "recording string, channel string, t double, amp double"


def exact(rate) -> Fraction:
    """A rate as a fraction: whole numbers, decimals as they are written, and fractions."""
    value = rate if isinstance(rate, Fraction) else Fraction(str(rate))
    if value <= 0:
        raise ValueError(f"a rate must be greater than 0, not {rate}")
    return value


def indexed(samples: DataFrame, rate: Fraction) -> DataFrame:
    """``recording, channel, n, amp``: one row for each index."""
    n = F.round(F.col("t") * rate.numerator / rate.denominator).cast("long").alias("n")
    amp = F.col("amp").cast("double")
    fine = F.col("t").isNotNull() & amp.isNotNull() & ~F.isnan(amp) & (F.abs(amp) < float("inf"))
    return samples.where(fine).select("recording", "channel", n, amp.alias("amp")).groupBy("recording", "channel", "n").agg(F.max("amp").alias("amp"))


def _reaching(rows: DataFrame, low: Column, high: Column, chunk: int) -> DataFrame:
    """Every row once for each chunk of results from ``low`` to ``high``."""
    return rows.withColumn("chunk", F.explode(F.sequence(F.floor(low / chunk), F.floor(high / chunk))))


def _laid(n: np.ndarray, amp: np.ndarray, first: int, size: int) -> np.ndarray:
    out = np.zeros(size)
    inside = (n >= first) & (n < first + size)
    out[n[inside] - first] = amp[inside]
    return out


def resampling_taps(steps: np.ndarray, up: int, down: int) -> np.ndarray:
    """The low-pass filter at distances of ``steps`` of the common rate (``up`` times the old one, ``down`` times the new one): a Blackman-windowed sinc."""
    slow = max(up, down)
    half = CROSSINGS * slow
    window = 0.42 + 0.5 * np.cos(np.pi * steps / half) + 0.08 * np.cos(2 * np.pi * steps / half)
    return np.where(np.abs(steps) <= half, up * ROLLOFF / slow * np.sinc(ROLLOFF * steps / slow) * window, 0.0)


def resampled(samples: DataFrame, rate_in, rate_out, chunk: int = CHUNK) -> DataFrame:
    """``recording, channel, t, amp`` at ``rate_out`` from samples at ``rate_in``, band-limited to ``ROLLOFF`` of half the lower rate.

    A polyphase filter: result m lies ``m * down`` steps of the common rate from the start and meets the samples n with ``n * up`` steps near it; the taps
    depend on ``m * down`` modulo ``up`` only. Results lie between a channel's first and last sample. Equal rates change nothing.
    """
    old, new = exact(rate_in), exact(rate_out)
    up, down = (new / old).as_integer_ratio()
    rows = indexed(samples, old)
    seconds = lambda m: m.cast("double") * new.denominator / new.numerator
    if up == down:
        return rows.select("recording", "channel", seconds(F.col("n")).alias("t"), "amp")
    half = CROSSINGS * max(up, down)
    ends = rows.groupBy("recording", "channel").agg(F.ceil(F.min("n") * up / down).alias("first"), F.floor(F.max("n") * up / down).alias("last"))
    low, high = F.ceil((F.col("n") * up - half) / down), F.floor((F.col("n") * up + half) / down)
    rows = rows.join(ends, ["recording", "channel"]).withColumns({"low": F.greatest(low, "first"), "high": F.least(high, "last")}).where("low <= high")
    rows = _reaching(rows, F.col("low"), F.col("high"), chunk)
    phases = np.arange(up)
    wide = 2 * half // up + 2

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = max(int(pdf["first"].iloc[0]), key[2] * chunk), min(int(pdf["last"].iloc[0]), (key[2] + 1) * chunk - 1)
        m = np.arange(first, last + 1)
        start = -((half - m * down) // up)  # the first sample that reaches the result
        base = int(start[0]) if len(m) else 0
        x = _laid(pdf["n"].to_numpy(), pdf["amp"].to_numpy(), base, int(start[-1] - base) + wide if len(m) else 0)
        taps = np.stack([resampling_taps(p + (-((half - p) // up)) * -up - np.arange(wide) * up, up, down) for p in phases])
        amp, step = np.empty(len(m)), max(1, PRODUCTS // wide)
        for at in range(0, len(m), step):
            part = slice(at, at + step)
            amp[part] = (x[(start[part] - base)[:, None] + np.arange(wide)] * taps[m[part] * down % up]).sum(1)
        return pd.DataFrame({"recording": key[0], "channel": key[1], "t": m * float(new.denominator) / new.numerator, "amp": amp})

    return rows.select("recording", "channel", "chunk", "n", "amp", "first", "last").groupBy("recording", "channel", "chunk").applyInPandas(one, _OUT)


def filtered(samples: DataFrame, kernel: np.ndarray, rate, chunk: int = 4 * CHUNK) -> DataFrame:
    """Samples convolved with a kernel of odd length, centred: overlap-save, one Fourier transform a chunk. Results lie where samples are."""
    rate, kernel = exact(rate), np.asarray(kernel, dtype=float)
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel needs an odd length")
    half = len(kernel) // 2
    n = F.col("n")
    rows = _reaching(indexed(samples, rate), n - half, n + half, chunk)
    size = 1 << (chunk + 2 * half - 1).bit_length()

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at, first = pdf["n"].to_numpy(), key[2] * chunk
        own = np.sort(at[(at >= first) & (at < first + chunk)])
        x = _laid(at, pdf["amp"].to_numpy(), first - half, size)
        # the transform wraps round: its first 2 * half results are spoilt, the next ``chunk`` are the chunk's
        y = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(kernel, size), size)[2 * half : 2 * half + chunk]
        return pd.DataFrame({"recording": key[0], "channel": key[1], "t": own * float(rate.denominator) / rate.numerator, "amp": y[own - first]})

    return rows.groupBy("recording", "channel", "chunk").applyInPandas(one, _OUT)


def band_kernel(low: float, high: float, rate: float) -> np.ndarray:
    """A Hamming-windowed band-pass of 3.3 periods of its lower edge."""
    if not 0 < low < high:
        raise ValueError("a band needs 0 < low < high")
    taps = int(3.3 * rate / low) | 1
    n = np.arange(taps) - taps // 2
    return (2 * high / rate * np.sinc(2 * high / rate * n) - 2 * low / rate * np.sinc(2 * low / rate * n)) * np.hamming(taps)
