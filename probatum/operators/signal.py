"""Event-locked averages and the verdict on a peak's latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.operators import filters

#: Fixed values, in milliseconds unless named otherwise.
WINDOW = (80.0, 120.0)
TMIN_S, TMAX_S, CROP_S, CHANNELS, RATE_HZ, BAND_HZ = -0.1, 0.3, 90.0, 60, 200.0, (1.0, 40.0)
P50_UPPER, P200_LOWER, P200_UPPER, REFUTE_MARGIN = 70.0, 170.0, 215.0, 60.0
SEARCH_FLOOR, SEARCH_CEILING, SEARCH_MARGIN, EDGE, RELIABLE_EPOCHS = 30.0, 280.0, 20.0, 1.0, 8


def refute_threshold(high: Column) -> Column:
    return F.greatest(F.lit(P200_UPPER), high + REFUTE_MARGIN)


def latency_zone(latency: Column, low: Column, high: Column) -> Column:
    return (
        F.when(latency.isNull(), "no_peak").when(latency.between(low, high), "supported").when(latency <= P50_UPPER, "p50_ambiguous")
        .when(latency.between(P200_LOWER, P200_UPPER), "p200_ambiguous").when(latency > refute_threshold(high), "refutable")
        .when(latency < low, "off_window_early").otherwise("off_window_late")
    )


def search_bounds(first: Column, last: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The searched range in seconds, inside the epoch's times."""
    ceiling = F.least(F.lit(SEARCH_CEILING), refute_threshold(high) + SEARCH_MARGIN)
    return F.greatest(first, F.least(F.lit(SEARCH_FLOOR), low) / 1000), F.least(last, ceiling / 1000)


def finding(peaks: DataFrame) -> DataFrame:
    """Adds ``zone, verdict, caveats, next_step, has_next_step`` to ``peaks (latency_ms, amplitude, n_epochs, search_lo_ms, search_hi_ms, window_lo, window_hi)``.

    A peak within ``EDGE`` of the searched range cannot refute; a refutation from few epochs or without amplitude is inconclusive.
    """
    lat, lo, hi = F.col("latency_ms"), F.col("search_lo_ms"), F.col("search_hi_ms")
    zone = latency_zone(lat, F.col("window_lo"), F.col("window_hi"))
    rows = peaks.withColumn("zone", zone)
    first = F.when(F.col("zone") == "supported", "supported").when(F.col("zone") == "refutable", "refuted").otherwise("inconclusive")
    edge = F.coalesce(F.least(F.abs(lat - lo), F.abs(lat - hi)) <= EDGE, F.lit(False))
    late = F.coalesce(hi <= refute_threshold(F.col("window_hi")), F.lit(False))
    few = F.coalesce(F.col("n_epochs") < RELIABLE_EPOCHS, F.lit(False))
    rows = rows.withColumn("verdict", F.when(edge & (first != "supported"), "inconclusive").otherwise(first))
    weak = (F.col("verdict") == "refuted") & (few | F.col("amplitude").isNull())
    ambiguous = F.col("zone").isin("p50_ambiguous", "p200_ambiguous")
    caveats = F.array_compact(F.array(F.when(edge, "boundary_hit"), F.when(late, "unfalsifiable_late"), F.when(ambiguous, "component_ambiguous"), F.when(few, "low_evidence")))
    more = F.when(weak, "average more epochs, and record the amplitude, before refuting").when(edge & (first != "supported"), "widen the searched range: the peak lies at its edge")
    rows = rows.withColumns({"next_step": more, "has_next_step": more.isNotNull()})
    return rows.withColumns({"caveats": caveats, "verdict": F.when(weak, "inconclusive").otherwise(F.col("verdict"))})


def picked(samples: DataFrame, channels: DataFrame, kinds: tuple[str, ...] = ("grad", "stim")) -> DataFrame:
    """Samples of good channels of some kinds; ``channels (recording, channel, kind, bad)``."""
    good = channels.where(F.col("kind").isin(*kinds) & ~F.coalesce("bad", F.lit(False))).select("recording", "channel").distinct()
    return samples.join(good, ["recording", "channel"], "left_semi")


def cropped(samples: DataFrame, seconds: float = CROP_S, channels: int = CHANNELS) -> DataFrame:
    """The first ``seconds`` of each recording's first ``channels`` channels by name."""
    order = Window.partitionBy("recording").orderBy("channel")
    picks = samples.select("recording", "channel").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= channels)
    return samples.where(F.col("t") <= seconds).join(picks.drop("n"), ["recording", "channel"])


def rising_edges(stim: DataFrame) -> DataFrame:
    """``recording, t, code`` where a trigger channel ``(recording, t, code)`` goes up."""
    w = Window.partitionBy("recording").orderBy("t")
    before = F.coalesce(F.lag("code").over(w), F.lit(0))
    return stim.withColumn("_b", before).where(F.col("code") > F.col("_b")).select("recording", "t", "code")


def modal_code(triggers: DataFrame) -> DataFrame:
    """``recording, code, n``: each recording's most frequent code, of ties the one seen first."""
    seen = triggers.groupBy("recording", "code").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    return seen.withColumn("k", F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("n"), "first", "code"))).where("k = 1").select("recording", "code", "n")


def epochs(samples: DataFrame, triggers: DataFrame, tmin: float = TMIN_S, tmax: float = TMAX_S) -> DataFrame:
    """``recording, event_t, channel, lag, amp``: samples around each trigger, a range join made an equi-join by time buckets."""
    width = tmax - tmin
    bucket = lambda c: F.floor(c / width).cast("long")
    spans = triggers.select("recording", F.col("t").alias("event_t")).withColumn("bucket", F.explode(F.sequence(bucket(F.col("event_t") + tmin), bucket(F.col("event_t") + tmax))))
    near = samples.withColumn("bucket", bucket(F.col("t"))).join(spans, ["recording", "bucket"])
    return near.withColumn("lag", F.col("t") - F.col("event_t")).where(F.col("lag").between(tmin, tmax)).select("recording", "event_t", "channel", "lag", "amp")


#: Amplitudes are summed as whole multiples of this, so that a mean does not depend on the order of its rows.
GRAIN = 1e-6


def whole(amp: Column, grain: float = GRAIN) -> Column:
    return F.round(amp * F.lit(float(round(1 / grain)))).cast("long")


def _mean(total: Column, n: Column) -> Column:
    return F.floor(total.cast("double") / n).cast("long")


def baseline_corrected(rows: DataFrame, grain: float = GRAIN) -> DataFrame:
    """Each epoch's amplitudes less their mean at lags up to 0, in whole grains."""
    w = Window.partitionBy("recording", "event_t", "channel")
    before = F.when(F.col("lag") <= 0, whole(F.col("amp"), grain))
    mean = F.coalesce(_mean(F.sum(before).over(w), F.count(before).over(w)), F.lit(0))
    return rows.withColumn("amp", (whole(F.col("amp"), grain) - mean) / F.lit(round(1 / grain)))


def averaged(rows: DataFrame, step: float, grain: float = GRAIN) -> DataFrame:
    """``recording, channel, lag_step, amp, n``: the mean over epochs in lag steps, in whole grains."""
    out = rows.groupBy("recording", "channel", F.floor(F.col("lag") / step).cast("long").alias("lag_step")).agg(F.sum(whole(F.col("amp"), grain)).alias("total"), F.count("*").alias("n"))
    return out.select("recording", "channel", "lag_step", (_mean(F.col("total"), F.col("n")) / F.lit(round(1 / grain))).alias("amp"), "n")


def peak(evoked: DataFrame, low_step: int, high_step: int) -> DataFrame:
    """The greatest absolute amplitude of each recording between two lag steps; of ties the first lag, then channel."""
    w = Window.partitionBy("recording").orderBy(F.desc(F.abs("amp")), "lag_step", "channel")
    return evoked.where(F.col("lag_step").between(low_step, high_step)).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def band_passed(samples: DataFrame, low: float = BAND_HZ[0], high: float = BAND_HZ[1], rate: float = RATE_HZ) -> DataFrame:
    """Windowed-sinc band-pass per recording and channel; samples must be evenly spaced at ``rate``."""
    return filters.filtered(samples, filters.band_kernel(low, high, float(rate)), rate)


def resampled(samples: DataFrame, sampling, rate=RATE_HZ) -> DataFrame:
    """Samples at ``rate`` from samples evenly spaced at ``sampling``, band-limited."""
    return filters.resampled(samples, sampling, rate)


def synthetic(spark: SparkSession, peak_ms: float = 100.0, n_epochs: int = 40, channels: int = 4, rate: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Samples and triggers of a made-up recording with a planted peak; a peak outside the epoch is refused."""
    if not 0 < peak_ms < TMAX_S * 1000:
        raise ValueError(f"a peak at {peak_ms} ms is not inside the epoch")
    triggers = spark.range(1, n_epochs + 1).select(F.lit("synthetic").alias("recording"), F.col("id").cast("double").alias("t"), F.lit(1).alias("code"))
    at = (F.pmod("id", F.lit(rate)) / rate - peak_ms / 1000) / 0.012
    base = spark.range((n_epochs + 2) * rate).select((F.col("id") / rate).alias("t"), F.exp(-at * at / 2).alias("shape"), F.col("id"))
    channel = F.explode(F.sequence(F.lit(1), F.lit(channels))).alias("c")
    rows = base.select("t", "shape", "id", channel)
    live = (F.col("t") >= 1) & (F.col("t") < n_epochs + 1)
    amp = F.when(live, F.col("shape") / F.col("c")).otherwise(0.0) + F.sin(F.col("id") * 12.9898 + F.col("c")) * 0.01
    return rows.select(F.lit("synthetic").alias("recording"), F.concat(F.lit("MEG"), F.col("c")).alias("channel"), "t", amp.alias("amp")), triggers
