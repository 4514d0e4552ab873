"""A chunk index as versioned Parquet folders, the manifest that makes a version current, and fingerprints of its content.

A version is written whole beside the others; the manifest, one small file, is then replaced by one rename. Readers see
the old version until then, and versions that a manifest once named stay readable.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import stable_sha256
from granary.operators.chunks import synced
from granary.sources import files

CRITICAL = ("embedding_model", "dimension", "chunker_version", "parser_version", "cleaner_version", "metadata_schema_version")
# A manifest's version, and the fields in which it must equal the running configuration.
MANIFEST_VERSION = 1
CONFIG = ("embedding_provider", "embedding_model", "embedding_dimension", "collection_name", "distance_metric", "parser_version", "cleaner_version", "chunker_version", "metadata_schema_version")
#: Hexadecimal digits of a record's id hash that name the nodes of the fingerprint tree, level by level.
LEVELS = (6, 4, 2)


def build(chunks: DataFrame, path: str, version: str, manifest: dict) -> None:
    """Writes a whole version, then the manifest that names it."""
    if chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        raise ValueError("chunk ids are not unique")
    chunks.write.mode("errorifexists").parquet(f"{path}/versions/{version}")
    files.replace(chunks.sparkSession, f"{path}/manifest.json", json.dumps({k: str(v) for k, v in {**manifest, "version": version}.items()}, ensure_ascii=False, indent=2))


def manifest_of(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(files.read(spark, f"{path}/manifest.json"))


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/{manifest_of(spark, path)['version']}")


def compatible(found: dict[str, str], wanted: dict) -> list[str]:
    """Critical fields that differ."""
    return [k for k in CRITICAL if found.get(k) != (str(wanted[k]) if k in wanted else None)]


def described(config: dict, now: str | None = None, before: dict | None = None) -> dict[str, str]:
    """The manifest of a configuration (CONFIG), new or in place of one before, whose time of creation it keeps."""
    now = now or datetime.now(UTC).isoformat().replace("+00:00", "Z")
    return {"manifest_version": str(MANIFEST_VERSION), **{k: str(config[k]) for k in CONFIG if config.get(k) is not None}, "created_at": (before or {}).get("created_at", now), "updated_at": now}


def problems(manifest: dict[str, str]) -> list[str]:
    """What makes a manifest unreadable: missing fields, a dimension or times that cannot be."""
    out = [k for k in CONFIG if k != "embedding_dimension" and not manifest.get(k)]
    out += ["manifest_version"] * (manifest.get("manifest_version") != str(MANIFEST_VERSION))
    dimension = manifest.get("embedding_dimension")
    out += ["embedding_dimension"] * (dimension is not None and not (dimension.isdigit() and int(dimension) > 0))
    try:
        created, updated = (datetime.fromisoformat(manifest[k].replace("Z", "+00:00")) for k in ("created_at", "updated_at"))
        out += ["times"] * (created.tzinfo is None or updated.tzinfo is None or updated < created)
    except (KeyError, ValueError):
        out.append("times")
    return out


def state(spark: SparkSession, path: str, config: dict) -> str:
    """empty, compatible or legacy_read_only (versions without a manifest); a manifest that is unreadable or of another configuration is an error."""
    if not files.exists(spark, f"{path}/manifest.json"):
        return "legacy_read_only" if files.names(spark, f"{path}/versions") else "empty"
    try:
        found = manifest_of(spark, path)
    except ValueError as error:
        raise ValueError("the manifest is not JSON") from error
    if wrong := problems(found):
        raise ValueError(f"the manifest is not valid: {', '.join(wrong)}")
    if other := [k for k in CONFIG if found.get(k) != (str(config[k]) if config.get(k) is not None else None)]:
        raise ValueError(f"the index is of another configuration: {', '.join(other)}")
    return "compatible"


def sync(spark: SparkSession, path: str, chunks: DataFrame, version: str, allow_empty: bool = False) -> dict[str, int]:
    """Writes the next version: what is unchanged is copied from the current one, what is new comes from chunks; the counts of both and of what goes."""
    if not files.exists(spark, f"{path}/manifest.json"):
        raise ValueError("an index without a manifest is read only")
    if not allow_empty and chunks.isEmpty():
        raise ValueError("an empty corpus would delete the index")
    stored, manifest = current(spark, path), manifest_of(spark, path)
    actions = synced(stored, chunks)
    kept = stored.join(actions.filter("action = 'unchanged'"), "chunk_id", "left_semi")
    new = chunks.join(actions.filter("action = 'add'"), "chunk_id", "left_semi").select(stored.columns)
    counts = {r.action: r.n for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    build(kept.unionByName(new), path, version, {k: v for k, v in manifest.items() if k != "version"})
    return {k: counts.get(k, 0) for k in ("add", "delete", "unchanged")}


def fingerprint_tree(records: DataFrame, key: str, text: str, metadata: Column) -> DataFrame:
    """prefix and hash of the nodes of a hash tree over records (key, text, metadata); the root's prefix is empty.

    A record's hash covers its key and the hashes of its text and metadata. Records meet by the first digits of their
    key's hash, level by level, 256 children each, so that no row ever holds more than a small part of the index, and two
    indexes differ only below nodes that differ. Repeated records count.
    """
    leaf = stable_sha256(F.col(key), F.sha2(text, 256), F.sha2(metadata, 256))
    level = records.select(F.left(F.sha2(key, 256), F.lit(LEVELS[0])).alias("prefix"), leaf.alias("hash"))
    level = level.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), "\n"), 256).alias("hash"))
    out = level
    for n in (*LEVELS[1:], 0):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "hash"))), lambda x: x["hash"]), "\n")
        level = level.groupBy(F.left("prefix", F.lit(n)).alias("up")).agg(F.sha2(children, 256).alias("hash")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level)
    return out


def differing(first: DataFrame, second: DataFrame) -> DataFrame:
    """The prefixes of nodes that only one of two trees has, or that differ."""
    a, b = first.select("prefix", F.col("hash").alias("a")), second.select("prefix", F.col("hash").alias("b"))
    return a.join(b, "prefix", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
