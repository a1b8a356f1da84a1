"""What the operators of this subpackage share: scratch tables, id hygiene, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.sources.shipping import ship

SLICE = 256


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only where none is set and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that no plan holds any more, which it does only after garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives freed memory of this process back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, ``SLICE`` at a time, so that only those become Python objects; freed memory goes back after each batch."""
    rows = rows or SLICE
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        trim()


_held: list[tuple[str, Callable[[], None]]] = []


def alone(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called in a Python worker by the operator that begins there: Spark uses workers again, so what another one has cached in this worker goes."""
    if _held and _held[0][0] == name:
        return
    for _, drop in _held:
        drop()
    if _held:
        gc.collect()
        trim()
    _held[:] = [(name, clear)]


def hash_bound(wanted: int, rows: int, lowest: int) -> int:
    """The greatest 64-bit hash of a sample of about ``wanted`` of ``rows``; the row of the ``lowest`` hash is always in it."""
    return (1 << 63) - 1 if rows <= wanted else max(lowest, (wanted << 64) // rows - (1 << 63))


def sampled(rows: DataFrame, key: Column, wanted: int) -> DataFrame:
    """About ``wanted`` rows, whatever the size of the table: those with the least hashes ``key``. Equal rows come together."""
    about = rows.agg(F.count("*"), F.min(key)).first()
    return rows.where(key <= F.lit(hash_bound(wanted, about[0], about[1] if about[0] else 0)))


def some(chosen: list, of: DataFrame) -> list:
    """``chosen``, which must not be empty where the table it was sampled from has rows."""
    if not chosen and of.take(1):
        raise ValueError("the sample is empty though the table has rows")
    return chosen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is a minimum per node, pre-aggregated map-side, joined
    back to the edges, so a node with very many links is only the skewed side of a join. Each round is written
    to the shared folder. Nothing but two counters reaches the driver: the joins are sorted, so that no side of a round is
    collected there to be broadcast, and what the plans of a round left on its heap is freed before the next.
    """
    cur = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _digest(cur)
    while state[0]:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(
            small.unionAll(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct(),
            "edges",
        )
        forget(cur)
        release(cur.sparkSession)
        cur, before, state = nxt, state, _digest(nxt)
        if state == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
