"""Lookups over the network as a data source: ``spark.read.format("lookups")``.

Requests lie on shared storage, one folder for each host and slice; a folder is a partition, so a host is asked by a known number of readers, each of which keeps to its
part of the host's rate. An answer (``ok`` or ``absent``; for probes any status) is put into a cache of its own file before its row is handed on, under the digest of its
URL, and the first one written stays. A task that is killed and starts anew, and a later run, ask for nothing that has been answered; only the
request under way when a task dies may be sent again. Lookups that could not be made are not kept: another run makes them.

Readers have no Spark session, so storage must be one that ``pyarrow.fs`` reaches from a worker too.
"""

from __future__ import annotations

import contextlib
import hashlib
import importlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from probatum.sources import live
from probatum.sources.shared import shared_dir
from probatum.sources.shipping import ship

#: Requests a second to one host, and the readers that share them.
RATE, READERS = 10.0, 1
SCHEMAS = {"get": "url string, outcome string, body string, error string", "probe": "url string, http_status int, final_url string, error string"}


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{os.path.abspath(uri)}")


class Answers:
    """Answers by the digest of their URL, each written once."""

    def __init__(self, uri: str, kind: str):
        self.fs, base = storage(uri)
        self.base = f"{base}/{kind}"

    def path(self, url: str) -> str:
        digest = hashlib.sha256(url.encode("utf-8", "surrogatepass")).hexdigest()
        return f"{self.base}/{digest[:3]}/{digest}.json"

    def get(self, url: str) -> list | None:
        path = self.path(url)
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, url: str, answer: list) -> list:
        """Keeps an answer, unless there is one; returns the one that is kept."""
        path = self.path(url)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(answer).encode())
        if isinstance(self.fs, pafs.LocalFileSystem):
            with contextlib.suppress(FileExistsError):
                os.link(draft, path)
            os.unlink(draft)
        elif self.get(url) is None:
            self.fs.move(draft, path)
        else:
            self.fs.delete_file(draft)
        return self.get(url)


class Pace:
    """Waits so that calls come no faster than ``rate`` a second."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], object] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / rate if rate > 0 else 0.0, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


@dataclass
class Folder(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def named(name: str) -> Callable[..., live.Answer]:
    """A transport by its name, ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class LookupReader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests, self.cache, self.kind = options["requests"], options["cache"], options.get("kind", "get")
        self.rate, self.readers = float(options.get("rate", RATE)), int(options.get("readers", READERS))
        self.transport = options.get("transport", "probatum.sources.live:ask")

    def partitions(self) -> list[Folder]:
        fs, base = storage(self.requests)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return [Folder(p) for p in sorted({i.path.rsplit("/", 1)[0] for i in found if i.type == pafs.FileType.File and i.path.endswith(".parquet")})]

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, _ = storage(self.requests)
        answers, pace, transport = Answers(self.cache, self.kind), Pace(self.rate / self.readers), named(self.transport)

        def paced(url, **how):
            pace.wait()
            return transport(url, **how)

        for info in fs.get_file_info(pafs.FileSelector(partition.path)):
            if not info.path.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1024, columns=["url"]):
                    for url in batch.column("url").to_pylist():
                        yield (url, *self.answer(url, answers, paced))

    def answer(self, url: str, answers: Answers, transport: Callable[..., live.Answer]) -> tuple:
        if (kept := answers.get(url)) is not None:
            return tuple(kept)
        got = live.probed(url, transport) if self.kind == "probe" else live.looked_up(url, transport)
        made = got[0] is not None if self.kind == "probe" else got[0] != "error"
        return tuple(answers.put(url, list(got))) if made else got


class Lookups(DataSource):
    """Options: ``requests`` (a folder that ``laid_out`` wrote), ``cache`` (a folder), ``kind`` (``get`` or ``probe``), ``rate`` (requests a second to a host), ``readers``, ``transport``."""

    @classmethod
    def name(cls) -> str:
        return "lookups"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "get")]

    def reader(self, schema) -> LookupReader:
        return LookupReader(dict(self.options))


def host_of(url):
    """The host and port of a URL, as a column."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def laid_out(urls: DataFrame, readers: int = READERS) -> str:
    """Writes different URLs of ``urls (url)`` by host and slice, and returns the folder."""
    path = f"{shared_dir(urls.sparkSession)}/requests-{uuid.uuid4().hex}"
    rows = urls.select("url").where("url <> ''").distinct()
    host = F.coalesce(F.nullif(F.hex(host_of(F.col("url"))), F.lit("")), F.lit("none"))  # hex: any host makes a folder's name
    rows = rows.withColumns({"host": host, "slice": F.pmod(F.xxhash64("url"), F.lit(readers))})
    rows.repartition("host", "slice").write.partitionBy("host", "slice").parquet(path)
    return path


def _loaded(urls: DataFrame, kind: str, cache: str, rate: float, readers: int, transport: str | None) -> DataFrame:
    spark = urls.sparkSession
    ship(spark)
    spark.dataSource.register(Lookups)
    options = {"requests": laid_out(urls, readers), "cache": cache, "kind": kind, "rate": str(rate), "readers": str(readers)} | ({"transport": transport} if transport else {})
    return spark.read.format("lookups").options(**options).load()


def responses(requests: DataFrame, cache: str, rate: float = RATE, readers: int = READERS, transport: str | None = None) -> DataFrame:
    """``provider, key, outcome, body, error`` for ``requests (provider, key, url)``, each different URL asked once; a request without a URL is an error."""
    got = _loaded(requests, "get", cache, rate, readers, transport)
    both = requests.select("provider", "key", F.col("url").alias("_url")).join(got, F.col("_url") == F.col("url"), "left")
    unasked = F.col("outcome").isNull()
    return both.select("provider", "key", F.coalesce("outcome", F.lit("error")).alias("outcome"), "body", F.when(unasked, F.lit("no URL")).otherwise(F.col("error")).alias("error"))


def probes(urls: DataFrame, cache: str, rate: float = RATE, readers: int = READERS, transport: str | None = None) -> DataFrame:
    """``url, http_status, final_url, error`` of each different URL."""
    return _loaded(urls, "probe", cache, rate, readers, transport)
