"""A journaled run: case results in parts that count once committed, and a report rebuilt from these alone.

A run is a folder: ``run.json`` (created once), ``parts`` with the rows of each part, one ``N.commit`` file a part, and
``completed.json``. A part is written under a name of its own first and counts from the moment its commit file names it;
what a killed attempt left is never read. Committing the same part again has no effect, whatever its rows are, so a
retried micro-batch is safe. A case that a committed part has is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import files


def begin(spark: SparkSession, path: str, about: dict) -> None:
    """A new run; one that is there already is never overwritten."""
    if not files.create(spark, f"{path}/run.json", json.dumps({**about, "run_status": "ready"}, ensure_ascii=False, sort_keys=True)):
        raise FileExistsError(f"a run is there already: {path}")


def status(spark: SparkSession, path: str) -> str:
    if files.exists(spark, f"{path}/completed.json"):
        return "completed"
    return "running" if files.names(spark, f"{path}/parts", ".commit") else "ready"


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of committed parts, with their part; None before the first."""
    commits = [json.loads(files.read(spark, f"{path}/parts/{name}")) for name in files.names(spark, f"{path}/parts", ".commit")]
    return spark.read.schema(commits[0]["schema"]).parquet(*[f"{path}/parts/{c['rows']}" for c in commits]) if commits else None


def append(path: str, part: int, rows: DataFrame, key: str = "case_id") -> bool:
    """Commits rows as a part of the run at path; False if that part is committed already. Repeated cases are an error, and so is a run that is over."""
    spark = rows.sparkSession
    if not files.exists(spark, f"{path}/run.json"):
        raise FileNotFoundError(f"no run: {path}")
    if files.exists(spark, f"{path}/parts/{part}.commit"):
        return False
    if files.exists(spark, f"{path}/completed.json"):
        raise ValueError("the run is completed")
    name = f"{part}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/parts/{name}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    new, before = spark.read.schema(schema).parquet(f"{path}/parts/{name}"), committed(spark, path)
    every = new.select(key) if before is None else new.select(key).unionByName(before.select(key))
    repeated = every.groupBy(key).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"the run has this case already: {repeated[0][0]}")
    return files.create(spark, f"{path}/parts/{part}.commit", json.dumps({"rows": name, "schema": schema}))


def aggregates(rows: DataFrame, metrics: list[str], failure: str = "failure", latency: str | None = None) -> DataFrame:
    """kind, name and value: each metric's mean over the cases that have it, the failures' counts, the number of cases and of milliseconds."""
    long = rows.unpivot([], metrics, "name", "x").groupBy("name").agg(F.round(F.avg("x"), 6).alias("value"))
    failures = rows.filter(F.col(failure).isNotNull()).groupBy(F.col(failure).alias("name")).agg(F.count("*").cast("double").alias("value"))
    sums = [F.count("*").cast("double").alias("cases")] + ([F.sum(latency).cast("double").alias("total_ms"), F.round(F.avg(latency), 6).alias("mean_ms")] if latency else [])
    totals = rows.agg(*sums).unpivot([], ["cases", *(["total_ms", "mean_ms"] if latency else [])], "name", "value")
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), "name", "value")
    return of(long, "metric").unionByName(of(failures, "failure")).unionByName(of(totals, "total"))


def report(spark: SparkSession, path: str, metrics: list[str], failure: str = "failure", latency: str | None = None) -> DataFrame:
    """The aggregates of what is committed; nothing that was computed before is used."""
    rows = committed(spark, path)
    if rows is None:
        raise ValueError("no part of the run is committed")
    return aggregates(rows, metrics, failure, latency)


def complete(spark: SparkSession, path: str, fingerprint_before: str, fingerprint_after: str) -> None:
    """Ends the run; refused if the index changed meanwhile, and then all parts stay as they are."""
    if fingerprint_before != fingerprint_after:
        raise ValueError("the index changed during the run")
    if not files.create(spark, f"{path}/completed.json", json.dumps({"index_fingerprint": fingerprint_after, "original_index_unchanged": True})):
        raise FileExistsError("the run is completed already")


def sink(path: str, key: str = "case_id"):
    """For ``writeStream.foreachBatch``: each micro-batch is a part of the run, by its number."""

    def write(rows: DataFrame, batch: int) -> None:
        append(path, batch, rows, key)

    return write
