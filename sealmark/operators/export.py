"""Exports that show less than their source: the sidecar that commits to both, and what a reader of it refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def projection(exported: DataFrame, source: DataFrame, key: str, shown: str, original: str) -> DataFrame:
    """(key, file, source_hash, projection_hash) of every exported row that differs from its source."""
    met = exported.join(source, key).filter(~F.col(shown).eqNullSafe(F.col(original)))
    return met.select(key, "file", F.sha2(original, 256).alias("source_hash"), F.sha2(shown, 256).alias("projection_hash"))


def repeats_a_field(record: Column) -> Column:
    """Whether a JSON object has a field twice, which parsers answer differently."""
    keys = F.json_object_keys(record)
    return F.size(keys) != F.size(F.array_distinct(keys))


def faults(records: DataFrame, files: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(key, fault) of the records of a sidecar that a reader refuses; the first fault of each."""
    of = lambda name: F.get_json_object(record, f"$.{name}")
    met = records.withColumn("_file", of("file")).join(files.select(F.col("file").alias("_known")), F.col("_file") == F.col("_known"), "left")
    fault = F.when(repeats_a_field(F.col(record)), "duplicate field").when(~F.coalesce(of("hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "not a digest").when(F.col("_known").isNull(), "unknown file")
    return met.select(key, fault.alias("fault")).filter("fault IS NOT NULL")
