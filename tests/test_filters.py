"""Resampling and filtering of recordings in chunks, against whole-array computations."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from probatum.operators import filters

SCHEMA = "recording string, channel string, t double, amp double, chunk long"


def frame(spark, x, rate, channel="c"):
    return spark.createDataFrame([("r", channel, i / rate, float(a), 1) for i, a in enumerate(x)], SCHEMA)


def values(df):
    rows = df.orderBy("t").collect()
    return np.array([r["t"] for r in rows]), np.array([r["amp"] for r in rows])


def amplitude(t, y, f):
    """Of the tone at ``f`` in the middle of a recording."""
    mid = slice(len(t) // 4, 3 * len(t) // 4)
    basis = np.stack([np.sin(2 * np.pi * f * t[mid]), np.cos(2 * np.pi * f * t[mid])], axis=1)
    return float(np.hypot(*np.linalg.lstsq(basis, y[mid], rcond=None)[0]))


@pytest.mark.parametrize(("old", "new", "kept", "gone"), [(1000, 200, 60.0, 130.0), (600, 250, 80.0, 140.0), (100, 150, 30.0, None), (Fraction(100), Fraction(100, 3), 10.0, 20.0)])
def test_a_tone_under_the_cut_stays_and_one_above_goes(spark, old, new, kept, gone):
    n = np.arange(int(6 * float(old)))
    x = 2.0 * np.sin(2 * np.pi * kept * n / float(old) + 0.3)
    y = x + (3.0 * np.sin(2 * np.pi * gone * n / float(old)) if gone else 0.0)
    t, out = values(filters.resampled(frame(spark, y, float(old)), old, new, chunk=256))
    assert np.allclose(np.diff(t), 1 / float(new)) and len(t) == int(n[-1] * Fraction(new) / Fraction(old)) + 1
    assert abs(amplitude(t, out, kept) / 2.0 - 1) < 1e-3
    alone = 2.0 * np.sin(2 * np.pi * kept * t + 0.3)
    mid = slice(len(t) // 4, 3 * len(t) // 4)
    assert np.abs(out[mid] - alone[mid]).max() < 5e-3


def test_resampling_is_the_direct_sum_and_the_same_for_all_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=900)
    df = frame(spark, x, 50.0)
    runs = [values(filters.resampled(df.repartition(p), 50, 20, chunk=100)) for p in (1, 7)]
    assert np.array_equal(runs[0][1], runs[1][1])
    up, down = 2, 5
    m = np.arange(0, 899 * up // down + 1)
    steps = m[:, None] * down - np.arange(900)[None] * up
    direct = (filters.resampling_taps(steps, up, down) * x).sum(1)
    assert np.abs(runs[0][1] - direct).max() < 1e-12
    other = values(filters.resampled(df, 50, 20, chunk=77))[1]
    assert np.abs(other - direct).max() < 1e-12


def test_chunks_filter_as_one_convolution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=5000)
    kernel = filters.band_kernel(2.0, 20.0, 100.0)
    whole = np.convolve(x, kernel)[len(kernel) // 2 :][: len(x)]
    df = frame(spark, x, 100.0)
    for chunk, parts in ((300, 1), (300, 6), (64, 3), (10_000, 2)):
        t, y = values(filters.filtered(df.repartition(parts), kernel, 100, chunk=chunk))
        assert len(y) == len(x) and np.allclose(t, np.arange(5000) / 100)
        assert np.abs(y - whole).max() < 1e-12


def test_the_band_passes_and_the_rest_goes(spark):
    n = np.arange(8000)
    tone = lambda f: np.sin(2 * np.pi * f * n / 200)
    kernel = filters.band_kernel(1.0, 40.0, 200.0)
    t, y = values(filters.filtered(frame(spark, tone(10) + tone(70) + 5.0, 200.0), kernel, 200))
    assert abs(amplitude(t, y, 10.0) - 1) < 1e-2 and amplitude(t, y, 70.0) < 1e-2 and abs(y[2000:6000].mean()) < 2e-2


def test_channels_stay_apart_and_odd_rows_take_no_part(spark):
    a, b = np.ones(400), np.zeros(400)
    rows = frame(spark, a, 100.0, "a").unionAll(frame(spark, b, 100.0, "b"))
    odd = spark.createDataFrame([("r", "a", None, 1.0, 1), ("r", "a", 1.0, None, 1), ("r", "a", 2.0, float("nan"), 1), ("r", "b", 1.0, -5.0, 1), ("r", None, 0.0, 1.0, 1)], SCHEMA)
    out = filters.resampled(rows.unionAll(odd), 100, 50, chunk=50)
    got = {(r["channel"], round(r["t"], 6)): r["amp"] for r in out.collect()}
    assert abs(got[("a", 2.0)] - 1) < 1e-3 and got[("b", 2.0)] == 0.0 and len([k for k in got if k[0] == "a"]) == 200
    same = filters.resampled(rows.unionAll(odd), 100, 100)
    assert same.where("channel = 'b'").count() == 400  # the greater of two samples at one time
    assert same.where("channel = 'b' and amp <> 0").count() == 0
    empty = rows.limit(0)
    assert filters.resampled(empty, 100, 50).collect() == [] and filters.filtered(empty, np.ones(3), 100).collect() == []


def test_rates_and_bands_are_checked():
    assert filters.exact(33.3) == Fraction(333, 10) and filters.exact("0.5") == Fraction(1, 2)
    for bad in (0, -1):
        with pytest.raises(ValueError, match="greater than 0"):
            filters.exact(bad)
    with pytest.raises(ValueError, match="low < high"):
        filters.band_kernel(3.0, 2.0, 100.0)


def test_a_backend_of_ones_own_runs_a_study(spark, tmp_path):
    from probatum.operators import recordings, study

    class Doubled(recordings.Tables):
        def preprocess(self, samples):
            return super().preprocess(samples).withColumn("amp", F.col("amp") * 2)

    rate = 500.0
    n = np.arange(6000)
    x = np.exp(-(((n / rate) % 1 - 0.6) ** 2) / (2 * 0.012**2)) + 0.05 * np.sin(2 * np.pi * 180 * n / rate)
    samples = frame(spark, x, rate)
    triggers = spark.createDataFrame([("r", i + 0.5, 1) for i in range(11)], "recording string, t double, code int")
    for kind, scale in ((recordings.Tables, 1), (Doubled, 2)):
        store = study.StudyStore(spark, str(tmp_path / kind.__name__))
        backend = kind(samples, triggers, sampling=500, rate=200.0, band=(1.0, 40.0))
        out = study.run(store, "s", study.backend_steps(backend, str(tmp_path / f"work-{kind.__name__}")))
        assert out["status"] == "done" and abs(out["results"]["validate_finding"]["latency_ms"] - 100) <= 5
        top = spark.read.parquet(str(tmp_path / f"work-{kind.__name__}" / "measure_peak")).first()
        assert 0.6 * scale < top["amplitude"] < 1.1 * scale and top["n_epochs"] == 11
    with pytest.raises(ValueError, match="evoked, measure_peak"):
        study.backend_steps(type("Half", (), {"fetch_sample": print, "preprocess": print, "epoch": print})(), "w")
