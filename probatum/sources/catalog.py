"""Provider and dataset JSON as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions import text

DATASET = (
    "struct<dataset:struct<id:string,created:string,public:boolean,latestSnapshot:struct<tag:string,size:bigint,"
    "description:struct<Name:string,Authors:array<string>>,summary:struct<subjects:array<string>,modalities:array<string>,tasks:array<string>>>>>"
)
LISTING = "struct<datasets:struct<edges:array<struct<node:struct<id:string>>>>>"
FILES = "struct<snapshot:struct<id:string,files:array<struct<filename:string,size:bigint,urls:array<string>>>>>"


def datasets(bodies: DataFrame) -> DataFrame:
    """One flat row per dataset response ``(body)``; a response without a dataset has no row."""
    d, none = F.col("d.dataset"), F.array().cast("array<string>")
    snap = d["latestSnapshot"]
    rows = bodies.select(F.from_json("body", DATASET).alias("d")).where("d.dataset is not null")
    return rows.select(
        d["id"].alias("id"), F.coalesce(snap["description"]["Name"], F.lit("")).alias("name"), F.coalesce(snap["description"]["Authors"], none).alias("authors"),
        *[F.coalesce(snap["summary"][c], none).alias(c) for c in ("modalities", "subjects", "tasks")], snap["size"].alias("size"),
        F.coalesce(snap["tag"], F.lit("")).alias("latest_tag"), F.coalesce(d["created"], F.lit("")).alias("created"), d["public"].alias("public"),
    )


def listed(bodies: DataFrame, limit: int = 20) -> DataFrame:
    """``position, id`` of a listing's datasets in its order, at most ``limit`` (held within 1 and 100) before those without an id go."""
    edges = F.from_json("body", LISTING)["datasets"]["edges"]
    rows = bodies.select(F.posexplode(F.slice(edges, 1, max(1, min(limit, 100)))).alias("position", "e"))
    return rows.select("position", F.col("e.node.id").alias("id")).where("id is not null and id <> ''")


def files(bodies: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """``dataset, tag, filename, size, url`` of snapshot responses; with ``latest (id, latest_tag)`` only of those snapshots."""
    rows = bodies.select(F.from_json("body", FILES)["snapshot"].alias("s")).select(F.col("s.id").alias("sid"), F.explode("s.files").alias("f"))
    rows = rows.select(
        F.split_part("sid", F.lit(":"), F.lit(1)).alias("dataset"), F.split_part("sid", F.lit(":"), F.lit(2)).alias("tag"),
        F.col("f.filename").alias("filename"), F.col("f.size").alias("size"), F.coalesce(F.get("f.urls", F.lit(0)), F.lit("")).alias("url"),
    )
    if latest is not None:
        rows = rows.join(latest.select(F.col("id").alias("dataset"), F.col("latest_tag").alias("tag")), ["dataset", "tag"])
    return rows


_WORK = "struct<DOI:string,title:string,author:array<struct<family:string,name:string,given:string>>,published:{d},`published-print`:{d},`published-online`:{d},issued:{d},`updated-by`:{u},`update-to`:{u},relation:map<string,string>>"
WORK = _WORK.format(d="struct<`date-parts`:array<array<int>>>", u="array<struct<type:string,label:string>>")
OPENALEX = "struct<id:string,doi:string,display_name:string,publication_year:int,is_retracted:boolean,authorships:array<struct<author:struct<display_name:string>>>>"
DATACITE = "struct<doi:string,titles:array<struct<title:string>>,publicationYear:int,creators:array<struct<name:string,familyName:string>>>"


def normalized(responses: DataFrame) -> DataFrame:
    """Provider responses ``(provider, key, outcome, body)`` as the records that verification joins.

    A crossref title may be a list or a string, its work bare or under ``message``; a datacite work may stand under ``data`` and carries no
    retraction. A body that names nothing is ``absent``.
    """
    body = F.coalesce(F.get_json_object("body", "$.message"), F.col("body"))
    w = F.from_json(body, WORK)
    title = F.coalesce(F.get(F.from_json(w["title"], "array<string>"), F.lit(0)), F.when(~F.startswith(w["title"], F.lit("[")), w["title"]), F.lit(""))
    year = F.coalesce(*[F.get(F.get(w[c]["date-parts"], F.lit(0)), F.lit(0)) for c in ("published", "published-print", "published-online", "issued")])
    names = F.transform(F.coalesce(w["author"], F.from_json(F.lit("[]"), "array<struct<family:string,name:string,given:string>>")), lambda a: F.coalesce(F.nullif(a["family"], F.lit("")), a["name"], F.lit("")))

    def signal(updates):
        hit = F.get(F.filter(updates, lambda u: F.contains(F.lower(F.coalesce(u["type"], F.lit(""))), F.lit("retract"))), F.lit(0))
        return F.when(hit.isNotNull(), F.coalesce(F.nullif(hit["label"], F.lit("")), F.lit("retraction")))

    relation = F.get(F.map_keys(F.map_filter(w["relation"], lambda k, v: F.contains(F.lower(k), F.lit("retract")) & ~v.isin("", "[]", "{}", "null"))), F.lit(0))
    crossref = responses.where(F.col("provider") == "crossref").select("provider", "key", "outcome", title.alias("title"), year.alias("year"), names.alias("authors"), F.coalesce(signal(w["updated-by"]), signal(w["update-to"]), relation).alias("retraction"), F.lit(True).alias("named"))
    o = F.from_json("body", OPENALEX)
    flag = F.when(o["is_retracted"], F.lit("retraction (OpenAlex is_retracted)"))
    people = F.coalesce(F.transform(o["authorships"], lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), F.array().cast("array<string>"))
    openalex = responses.where(F.col("provider") == "openalex").select("provider", "key", "outcome", F.coalesce(o["display_name"], F.lit("")).alias("title"), o["publication_year"].alias("year"), people.alias("authors"), flag.alias("retraction"), (o["id"].isNotNull() | o["display_name"].isNotNull()).alias("named"))
    c = F.from_json(F.coalesce(F.get_json_object("body", "$.data.attributes"), F.get_json_object("body", "$.attributes")), DATACITE)
    makers = F.coalesce(F.transform(c["creators"], lambda a: F.coalesce(F.nullif(a["familyName"], F.lit("")), a["name"], F.lit(""))), F.array().cast("array<string>"))
    datacite = responses.where(F.col("provider") == "datacite").select("provider", "key", "outcome", F.coalesce(F.get(c["titles"], F.lit(0))["title"], F.lit("")).alias("title"), c["publicationYear"].alias("year"), makers.alias("authors"), F.lit(None).cast("string").alias("retraction"), c.isNotNull().alias("named"))
    every = crossref.unionAll(openalex).unionAll(datacite)
    outcome = F.when((F.col("outcome") == "ok") & ~F.coalesce("named", F.lit(False)), "absent").otherwise(F.col("outcome"))
    return every.select("provider", text.doi(F.col("key")).alias("doi"), outcome.alias("outcome"), "title", "year", "authors", "retraction")
