"""Deterministic text scanner: one pass over rows, all detectors in one projection."""

from __future__ import annotations

import copy
import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions.detectors import DETECTORS, NEEDED, NEEDED_ANY_CASE, Detector, passes

HIT = "array<struct<label:string,match:string>>"


def hits_of(text: Column, detector: Detector, allowed: tuple[str, ...] = ()) -> Column:
    """The matches of one detector that pass its gate and hold no allowed substring."""
    grouped = detector.gate in ("group", "entropy")
    p = F.lit(detector.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), (F.regexp_extract_all(text, p, F.lit(1)) if grouped else found).alias("g"))
    pairs = F.transform(found, lambda m: F.struct(m.alias("m"), m.alias("g"))) if not grouped else pairs

    def kept(x):
        ok = passes(detector, x["m"], x["g"])
        for a in allowed:
            ok = ok & ~F.contains(x["m"], F.lit(a))
        return ok

    out = F.transform(F.filter(pairs, kept), lambda x: F.struct(F.lit(detector.label).alias("label"), x["m"].alias("match")))
    if detector.label in NEEDED:
        out = F.when(F.contains(text, F.lit(NEEDED[detector.label])), out).otherwise(F.array().cast(HIT))
    if detector.label in NEEDED_ANY_CASE:
        low, words = F.lower(text), NEEDED_ANY_CASE[detector.label]
        out = F.when(functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), out).otherwise(F.array().cast(HIT))
    return out


def scanned(docs: DataFrame, text: str = "text", labels: tuple[str, ...] | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` but ``text``, with a row ``label, match`` per hit."""
    use = [d for d in DETECTORS if labels is None or d.label in labels]
    every = F.concat(*[hits_of(F.col(text), d, allowed) for d in use])
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(every).alias("h")).select(*keep, "h.label", "h.match")


#: Shapes that tell of one machine, person or place, and what they tell.
LINE_SHAPES = {
    "operator-host-path": (r"(?<![\w`/])/(?:home|Users|Volumes)/[\w.\-]+", "a path that names a machine's account or volume"),
    "raw-data-filename": (r"\b[\w\-]*\d{4}[_\-]\d{2}[_\-]\d{2}[\w\-]*\.(?:wav|mp3|flac|edf|fif|nii|csv)\b", "a recording's file name with its date"),
    "chat-platform-snowflake": (r"(?<!\d)\d{17,19}(?!\d)", "the number of an account or channel"),
}


def line_hits(docs: DataFrame, text: str = "text", shapes: dict[str, tuple[str, str]] | None = None, marker: str | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text``, with a row ``line, label`` for each line that holds a shape; lines from 1.

    A line that holds ``marker`` is exempt, as a whole and from every shape; unlike an allowed substring the marker need not stand in the match. Lines end as
    ``\n``, ``\r\n`` or ``\r``; a null text has none.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    lines = docs.select(*keep, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("_at", "_line"))
    if marker:
        lines = lines.where(~F.contains("_line", F.lit(marker)))
    held = F.array_compact(F.array(*[F.when(F.col("_line").rlike(p), F.lit(label)) for label, (p, _) in (shapes or LINE_SHAPES).items()]))
    return lines.select(*keep, (F.col("_at") + 1).alias("line"), F.explode(held).alias("label"))


def carries_content(path: Column, prefixes: tuple[str, ...], skipped: tuple[str, ...] = ()) -> Column:
    """Paths to scan: under a prefix, or Markdown at the top; none that starts like a skipped one."""
    out = F.endswith(path, F.lit(".md")) & ~F.contains(path, F.lit("/"))
    for p in prefixes:
        out = out | F.startswith(path, F.lit(p))
    for p in skipped:
        out = out & ~F.startswith(path, F.lit(p))
    return out


def shown(match: Column) -> Column:
    """A hit as reports show it: six characters and an ellipsis from twelve characters up."""
    return F.when(F.length(match) >= 12, F.concat(F.substring(match, 1, 6), F.lit("…"))).otherwise(match)


#: The most hits that a gate lists.
MOST = 10_000
#: What a gate without a configuration file uses.
DEFAULTS = {
    "sensitive_prefixes": ["docs/"],
    "deterministic": {"enabled": True, "allow_substrings": [], "skip_paths": []},
}


def load_config(spark: SparkSession, root: str, name: str = "scan.config.json") -> dict:
    """A gate's configuration from its file under ``root``, wherever Spark can read; the defaults where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return copy.deepcopy(DEFAULTS)
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all files under ``root``, paths from there; what is not UTF-8 has a null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    inside = F.element_at(F.split("path", "\\Q" + base + "\\E", 2), -1)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select(inside.alias("path"), text.alias("text"))


def gate(files: DataFrame, config: dict | None = None, semantic: DataFrame | None = None, only: bool = False, required: bool = False) -> dict:
    """What a gate over ``files (path, text)`` reports, and its exit code: 0 clean, 1 something found, 2 it could not be run as asked.

    The deterministic layer reads every file but those under a skipped prefix. The semantic layer's verdicts, where it ran, are rows of ``semantic
    (path, flagged)`` for the files that carry content; ``ran`` tells apart true, false and null (nothing to do), so that a layer that did
    not run never reads as a pass. ``required`` makes that an error, ``only`` leaves the layer out. At most ``MOST`` hits and flagged files are listed; the
    exit code counts all.
    """
    config = DEFAULTS if config is None else config
    if only and required:
        return {"exit_code": 2, "error": "a layer can't be left out and required"}
    rules = config.get("deterministic", {})
    content = files.where(carries_content(F.col("path"), tuple(config.get("sensitive_prefixes", []))))
    read = files.where(F.col("text").isNotNull())
    for prefix in rules.get("skip_paths", []):
        read = read.where(~F.startswith("path", F.lit(prefix)))
    hits = scanned(read, allowed=tuple(rules.get("allow_substrings", []))).select("path", "label", shown(F.col("match")).alias("shown")) if rules.get("enabled", True) else None
    found = [r.asDict() for r in hits.orderBy("path", "label", "shown").limit(MOST).collect()] if hits is not None else []
    flagged = [r["path"] for r in semantic.join(content.select("path"), "path").where("flagged").orderBy("path").limit(MOST).collect()] if semantic is not None and not only else []
    needed = not only and bool(content.take(1))
    ran = semantic is not None if needed else None
    code = 2 if required and ran is False else 1 if found or flagged else 0
    return {"exit_code": code, "hits": found, "flagged": flagged, "ran": ran, "error": "the semantic layer did not run" if code == 2 else None}


def verdict_in(reply: str, key: str = "flagged") -> dict:
    """The first JSON object of a text that holds ``key``, whatever prose is around it."""
    decoder, at = json.JSONDecoder(), reply.find("{")
    while at >= 0:
        try:
            got, _ = decoder.raw_decode(reply, at)
        except json.JSONDecodeError:
            got = None
        if isinstance(got, dict) and key in got:
            return got
        at = reply.find("{", at + 1)
    raise ValueError(f"no object with {key}: {reply[:400]!r}")


MARKDOWN = r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def links(pages: DataFrame, text: str = "html", pattern: str = r"href=[\"']([^\"']+)[\"']") -> DataFrame:
    """Link targets that stay inside: not http(s), mailto or a fragment."""
    keep = [c for c in pages.columns if c != text]
    found = pages.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("target"))
    return found.where(~F.col("target").rlike("^(https?:|mailto:|#)"))


def resolved(target: Column, path: Column) -> Column:
    """A link's target as a path from the top: without its fragment, from the linking file's folder unless it starts at the top."""
    bare = F.regexp_replace(target, "[#?].*$", "")
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = F.when(F.startswith(bare, F.lit("/")), F.substring(bare, 2, 1 << 30)).otherwise(F.concat(folder, bare))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(walked, "/")


def broken_links(pages: DataFrame, files: DataFrame, text: str = "text", pattern: str = MARKDOWN) -> DataFrame:
    """``path, target`` of links of ``pages (path, text)`` whose target is no file and no folder of ``files (path)``."""
    found = links(pages.select("path", text), text, pattern).withColumn("to", resolved(F.col("target"), F.col("path")))
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("to")).distinct()
    return found.where("to <> ''").join(every, "to", "left_anti").select("path", "target")


def archive(items: DataFrame, content: str, existing: DataFrame | None = None) -> DataFrame:
    """``sha256, path, copies``: one row per distinct content, named by the start of its hash; none that ``existing (path)`` holds."""
    digest = F.sha2(F.col(content), 256)
    out = items.where(F.col(content).isNotNull()).groupBy(digest.alias("sha256")).agg(F.count("*").alias("copies")).withColumn("path", F.concat(F.substring("sha256", 1, 16), F.lit(".bin")))
    return out if existing is None else out.join(existing.select("path").distinct(), "path", "left_anti").select("sha256", "copies", "path")


def archived(items: DataFrame, content: str, folder: str) -> DataFrame:
    """Writes what an archive does not hold yet and returns all it holds: ``sha256, path, content``."""
    spark, schema = items.sparkSession, f"sha256 string, path string, content {items.schema[content].dataType.simpleString()}"
    items.where("false").select(F.lit("").alias("sha256"), F.lit("").alias("path"), F.col(content).alias("content")).write.mode("ignore").parquet(folder)
    held = spark.read.schema(schema).parquet(folder)
    new = items.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    new = new.join(held.select("sha256"), "sha256", "left_anti").select("sha256", F.concat(F.substring("sha256", 1, 16), F.lit(".bin")).alias("path"), "content")
    new.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
