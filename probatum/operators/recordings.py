"""What a signal study runs on: a backend has five stages, each of which takes what the one before it left.

``fetch_sample()`` gives samples; ``preprocess(samples)`` filters them; ``epoch(samples)`` cuts them around events; ``evoked(epochs)`` averages;
``measure_peak(evoked, window)`` gives one row per recording with what ``signal.finding`` judges. All take and give tables, which the study
writes between the stages. ``Tables`` is the backend over tables of samples and triggers; any object with the five stages will do.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.operators import filters, signal

#: The stages in their order.
STAGES = ("fetch_sample", "preprocess", "epoch", "evoked", "measure_peak")


class Backend(Protocol):
    def fetch_sample(self) -> DataFrame: ...
    def preprocess(self, samples: DataFrame) -> DataFrame: ...
    def epoch(self, samples: DataFrame) -> DataFrame: ...
    def evoked(self, epochs: DataFrame) -> DataFrame: ...
    def measure_peak(self, evoked: DataFrame, window: tuple[float, float]) -> DataFrame: ...


def missing_stages(backend) -> list[str]:
    return [s for s in STAGES if not callable(getattr(backend, s, None))]


@dataclass
class Tables:
    """Stages over ``samples (recording, channel, t, amp)`` and ``triggers (recording, t, code)``, times in seconds.

    ``event`` is the trigger code to average, ``"all"`` for every one, or none for each recording's most frequent. With ``channels (recording, channel,
    kind, bad)`` only good ones of the usual kinds count. ``sampling`` is the rate of samples: where it is given they are resampled to
    ``rate`` and band-passed, else taken as they are. Amplitudes are summed in whole ``grain`` and averaged in steps of ``step`` seconds.
    """

    samples: DataFrame
    triggers: DataFrame
    channels: DataFrame | None = None
    event: int | str | None = None
    sampling: float | None = None
    rate: float = signal.RATE_HZ
    band: tuple[float, float] = signal.BAND_HZ
    epoch_s: tuple[float, float] = (signal.TMIN_S, signal.TMAX_S)
    crop_s: float = signal.CROP_S
    most_channels: int = signal.CHANNELS
    grain: float = signal.GRAIN
    step: float = 0.001

    def fetch_sample(self) -> DataFrame:
        rows = self.samples if self.channels is None else signal.picked(self.samples, self.channels)
        return signal.cropped(rows, self.crop_s, self.most_channels)

    def preprocess(self, samples: DataFrame) -> DataFrame:
        if self.sampling is None:
            return samples
        return filters.filtered(filters.resampled(samples, self.sampling, self.rate), filters.band_kernel(*self.band, float(self.rate)), self.rate)

    def chosen(self) -> DataFrame:
        if self.event == "all":
            return self.triggers
        if self.event is not None:
            return self.triggers.where(F.col("code") == int(self.event))
        return self.triggers.join(signal.modal_code(self.triggers).select("recording", "code"), ["recording", "code"], "left_semi")

    def epoch(self, samples: DataFrame) -> DataFrame:
        return signal.baseline_corrected(signal.epochs(samples, self.chosen(), *self.epoch_s), self.grain)

    def evoked(self, epochs: DataFrame) -> DataFrame:
        """The averages, and in ``epochs`` the number of events with any sample near them."""
        seen = epochs.groupBy("recording").agg(F.count_distinct("event_t").alias("n_epochs"))
        return signal.averaged(epochs.withColumn("lag", F.round("lag", 6)), self.step, self.grain).join(seen, "recording")

    def measure_peak(self, evoked: DataFrame, window: tuple[float, float]) -> DataFrame:
        low, high = (F.lit(float(x)) for x in window)
        first, last = signal.search_bounds(*(F.lit(x) for x in self.epoch_s), low, high)
        ms = lambda c: F.round(c * 1000, 6)
        inside = evoked.where(F.col("lag_step").between(F.round(first / self.step), F.round(last / self.step)))
        top = signal.peak(inside, -(1 << 40), 1 << 40)
        return top.select(
            "recording", "channel", ms(F.col("lag_step") * self.step).alias("latency_ms"), F.col("amp").alias("amplitude"), "n_epochs",
            ms(first).alias("search_lo_ms"), ms(last).alias("search_hi_ms"), low.alias("window_lo"), high.alias("window_hi"),
        )
