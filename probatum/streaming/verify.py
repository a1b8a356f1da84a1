"""An extension: verify each new reference of a stream once, against provider tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions import text
from probatum.operators.verify import verified


def verified_stream(refs: DataFrame, records: DataFrame, probes: DataFrame, event_time: str = "seen_at", late: str = "1 day") -> DataFrame:
    """References of a streaming frame, first sightings of a key within ``late`` only, joined to static provider tables."""
    key = text.reference_key(text.doi(F.col("doi")), F.col("title"), F.coalesce(F.col("url"), F.lit("")))
    once = refs.withColumn("ref_key", key).withWatermark(event_time, late).dropDuplicatesWithinWatermark(["ref_key"])
    return verified(once.drop("ref_key", event_time), records, probes)
