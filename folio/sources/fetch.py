"""Planned sources read through one Python data source, a partition for each.

There is no network here, so the reader replays responses stored as JSON lines
(``<responses>/<name>.jsonl``); a remote fetcher would override ``fetch`` and keep the schema. A source
that cannot be read gives one row with ``error`` set, or fails the read if ``strict`` is true.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "doc_id string, title string, text string, source string, year int, authors array<string>, venue string, doi string, url string"
SCHEMA = f"name string, {FIELDS}, error string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


class SourceUnavailable(Exception):
    pass


class _Planned(InputPartition):
    def __init__(self, name: str, most: int):
        self.name, self.most = name, most


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.strict = options["responses"], options.get("strict", "false").lower() == "true"
        self.plan = json.loads(options["plan"])

    def partitions(self) -> list[_Planned]:
        return [_Planned(p["name"], int(p.get("max_docs", 20))) for p in self.plan]

    def fetch(self, name: str, most: int) -> Iterator[tuple]:
        path = os.path.join(self.root, f"{name}.jsonl")
        if not os.path.exists(path):
            raise SourceUnavailable(f"no response for {name}")
        with open(path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if i >= most:  # max_docs is the feature
                    return
                d = json.loads(line)
                yield name, *[d.get(k) for k in _NAMES], None

    def read(self, partition: _Planned) -> Iterator[tuple]:
        try:
            yield from self.fetch(partition.name, partition.most)
        except Exception as e:
            if self.strict:
                raise
            yield partition.name, *[None] * len(_NAMES), f"{type(e).__name__}: {e}"


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options)


def fetch_planned(spark: SparkSession, plan: list[dict], responses: str, strict: bool = False) -> DataFrame:
    """The rows of all planned sources (``name``, ``max_docs``, 20 by default), errors as rows."""
    spark.dataSource.register(ReplaySource)
    return spark.read.format("folio_replay").options(plan=json.dumps(plan), responses=responses, strict=str(strict).lower()).load()


def fetch_audit(plan: list[dict], rows: DataFrame) -> DataFrame:
    """name, fetched, error of every planned source."""
    names = rows.sparkSession.createDataFrame([(p["name"],) for p in plan], "name string")
    sums = rows.groupBy("name").agg(F.count("doc_id").alias("fetched"), F.max("error").alias("error"))
    return names.distinct().join(sums, "name", "left").select("name", F.coalesce("fetched", F.lit(0)).alias("fetched"), "error")


def fetch_ids(spark: SparkSession, ids: list[str], responses: str, meta: DataFrame | None = None) -> DataFrame:
    """The records of one batched lookup (``<responses>/ids.jsonl``) among ``ids``, compared without their prefixes; ids
    without a record are missing. ``meta`` (doc_id, ord, tags and columns) is laid over them."""
    from folio.functions.text import bare_id
    from folio.operators.build import overlay

    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "wanted string").select(bare_id(F.col("wanted")).alias("bare")).distinct()
    found = fetch_planned(spark, [{"name": "ids", "max_docs": 2**31 - 1}], responses).where("error is null and doc_id is not null").drop("name", "error")
    found = found.withColumn("bare", bare_id(F.col("doc_id"))).join(wanted, "bare", "left_semi").drop("bare").dropDuplicates(["doc_id"])
    if meta is None:
        return found
    for c, kind in (("stratum", "string"), ("topic", "string"), ("note", "string"), ("tags", "array<string>")):
        found = found.withColumn(c, F.lit(None).cast(kind))
    return overlay(found, meta)


def fetch_doi(spark: SparkSession, doi: str, responses: str) -> DataFrame:
    """The record of a DOI (``<responses>/doi.jsonl``), at most one; its text is null unless deposited."""
    from folio.operators.corpus import doi_key

    rows = fetch_planned(spark, [{"name": "doi", "max_docs": 2**31 - 1}], responses).where("error is null").drop("name", "error")
    return rows.where(doi_key() == doi_key(F.lit(doi))).orderBy("doc_id").limit(1)
