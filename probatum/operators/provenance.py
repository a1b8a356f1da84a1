"""What a result must carry to be made again: seeds, versions, where it came from, and a path that no later run writes over."""

from __future__ import annotations

import platform
import random
import subprocess
import sys
from datetime import UTC, datetime
from importlib import import_module
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators.study import now


def seeded(seed: int = 42) -> dict:
    """Seeds the generators that are there and tells which."""
    random.seed(seed)
    out = {"seed": seed, "seeded": ["random"]}
    for name, calls in (("numpy", ("random.seed",)), ("torch", ("manual_seed", "cuda.manual_seed_all"))):
        try:
            library = import_module(name)
        except ImportError:
            continue
        for call in calls:
            target = library
            for part in call.split("."):
                target = getattr(target, part)
            target(seed)
        out["seeded"].append(name)
        out[f"{name}_version"] = library.__version__
    return out


def stamped(path: str, when: datetime | None = None) -> str:
    """``path`` with the UTC time of the run before its extension."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}.{(when or datetime.now(UTC)).astimezone(UTC):%Y%m%dT%H%M%SZ}{p.suffix}"))


def revision(folder: str | None = None) -> str | None:
    try:
        got = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=5, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return got.stdout.strip() or None


def provenance(seeds: dict | None = None, folder: str | None = None, **more) -> dict:
    block = {"generated_utc": now(), "script": Path(sys.argv[0]).name or "<interactive>", "git_sha": revision(folder), "python": platform.python_version()}
    return block | (seeds or {}) | more


def write_stamped(rows: DataFrame, path: str, block: dict | None = None, when: datetime | None = None) -> str:
    """Writes rows and their provenance to a stamped folder of JSON; one that exists is an error."""
    target = stamped(path, when)
    made = rows.withColumn("provenance", F.struct(*[F.lit(str(v)).alias(k) for k, v in (block or provenance()).items()]))
    made.write.mode("errorifexists").json(target)
    return target


def results_index(spark: SparkSession, path: str, run: str, metrics: dict[str, float], block: dict | None = None) -> None:
    """Appends one row per metric of a run to an index of results."""
    rows = [(run, k, float(v), str((block or {}).get("generated_utc") or now()), (block or {}).get("git_sha")) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run string, metric string, value double, generated_utc string, git_sha string").write.mode("append").parquet(path)
