"""CSV, JSON and parquet in and out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; columns are those of any part, in the order they are first seen."""
    if not parts:
        raise ValueError("nothing to unite")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; null is the empty field. Nested columns must be flattened first. Without rows
    nothing is written."""
    if df.isEmpty():
        return
    df.write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)


def _defined(df: DataFrame) -> DataFrame:
    """'nan' and 'None' as null, in every column."""
    clean = {}
    for f in df.schema:
        if f.dataType.simpleString() in ("double", "float"):
            clean[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif f.dataType.simpleString() == "string":
            clean[f.name] = F.when(~F.col(f.name).isin("nan", "None"), F.col(f.name))
    return df.withColumns(clean)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """'', 'nan' and 'None' are null, in every column."""
    return _defined(spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "nan").csv(path))


def read_runs(spark: SparkSession, pattern: str, schema: str | StructType) -> DataFrame:
    """Files under a pattern .../<run_tag>/<file>, with run_tag from the path; nulls as in read_csv()."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "nan").csv(pattern)
    tag = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return _defined(df.withColumn("run_tag", tag))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_result(records: DataFrame, summary: DataFrame, usage: dict[str, int], path: str) -> None:
    """One result: records and summary as JSON lines, side by side, and the usage counters."""
    write_json(records, f"{path}/records")
    write_json(summary, f"{path}/summary")
    write_json(records.sparkSession.createDataFrame([(k, int(v)) for k, v in sorted(usage.items())], "counter string, value long"), f"{path}/usage")


def read_records(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Result files with nested generators[].records[]: one row per record, with its generator."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    rows = df.select(F.explode("generators").alias("g")).select(F.col("g.generator").alias("generator"), F.explode("g.records").alias("r"))
    return rows.select("generator", "r.*")


def config_key(config: dict) -> str:
    """Names a cached result by everything it depends on."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """The table made for this configuration, from ``folder`` if it is there already."""
    path = f"{folder}/{config_key(config)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merged_config(base: dict, overlay: dict, quick: dict | None = None) -> dict:
    """Defaults, overlaid by a file's values, overlaid by the quick run's."""
    return {**base, **overlay, **(quick or {})}


def save_world(world: dict[str, DataFrame], folder: str) -> None:
    """docs, queries, pool and strata as JSON lines, one folder each."""
    for name, df in world.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def load_world(spark: SparkSession, folder: str, schemas: dict[str, str | StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}
