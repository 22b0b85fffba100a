"""File sources and sinks with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASKET = T.StructType(
    [T.StructField(n, t) for n, t in (("BillNo", T.IntegerType()), ("Itemname", T.StringType()), ("Quantity", T.IntegerType()), ("Date", T.StringType()), ("Price", T.StringType()), ("CustomerID", T.IntegerType()), ("Country", T.StringType()))]
)
RECOMMENDATION = ("user_id", "item_id", "score", "rank")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", timestamp_format: str | None = None) -> DataFrame:
    """Delimited text with a header and a declared schema; nothing is inferred."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    return (reader.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format) if timestamp_format else reader).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_basket(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Semicolon-separated basket lines without null fields; of one country if given, which must occur."""
    rows = read_csv(spark, path, BASKET, sep=";").na.drop("any")
    if country is None:
        return rows
    rows = rows.where(F.col("Country") == country)
    if rows.isEmpty():
        raise ValueError(f"no basket line of country {country!r}")
    return rows


ADJACENCY = T.StructType([T.StructField("node", T.StringType()), T.StructField("next", T.ArrayType(T.LongType()))])


def write_adjacency(edges: DataFrame, path: str, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> None:
    """One JSON object for each node: its key as a string and the sorted keys of its neighbours; ``nodes`` (src) without any have an empty list."""
    lists = edges.where(F.col(dst).isNotNull()).groupBy(src).agg(F.array_sort(F.collect_set(F.col(dst).cast("long"))).alias("next"))
    every = edges.select(src) if nodes is None else edges.select(src).unionByName(nodes.select(src))
    full = every.distinct().join(lists, src, "left")
    full.select(F.col(src).cast("string").alias("node"), F.coalesce("next", F.array().cast("array<bigint>")).alias("next")).write.mode("overwrite").json(path)


def read_adjacency_lists(spark: SparkSession, path: str) -> DataFrame:
    """(src, next) of every node of an adjacency, nodes without neighbours included."""
    return spark.read.schema(ADJACENCY).json(path).select(F.col("node").cast("long").alias("src"), "next")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst) of an adjacency; its nodes without neighbours are in :func:`read_adjacency_lists`."""
    return read_adjacency_lists(spark, path).select("src", F.explode("next").alias("dst"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents that span lines (metadata with a list)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def write_recommendations(recs: DataFrame, path: str, model_type: str, mode: str) -> None:
    """Append recommendations below one partition for each graph mode, after a check of their columns."""
    require(recs, RECOMMENDATION)
    recs.select(*RECOMMENDATION, F.lit(model_type).alias("model_type"), F.lit(mode).alias("graph_mode")).write.mode("append").partitionBy("graph_mode").parquet(path)


def append_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Log of metric rows by run."""
    metrics.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def write_metric_sheet(metrics: DataFrame, path: str, sheet: str) -> None:
    """Keep metric rows as one sheet of a log; a sheet of that name is replaced, others stay."""
    metrics.write.mode("overwrite").parquet(f"{path}/sheet={sheet}")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of a metric log with their names."""
    return spark.read.option("mergeSchema", True).parquet(path)


def rows_as_text(df: DataFrame) -> str:
    """A small table as one text: the rows' values in brackets, each row followed by a comma."""
    return "".join(f"[{', '.join(map(str, r))}]," for r in df.collect())


def next_run(spark: SparkSession, path: str) -> int:
    """Number of the next experiment run: one more than the largest in the run table, 1 if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return 1
    return int(spark.read.parquet(path).agg(F.max("run_no")).first()[0] or 0) + 1


def save_run(df: DataFrame, path: str) -> int:
    """Keep a result as the next numbered run."""
    number = next_run(df.sparkSession, path)
    df.withColumn("run_no", F.lit(number)).write.mode("append").parquet(path)
    return number


def promote(spark: SparkSession, path: str, run_no: int, target: str) -> None:
    """Make one run the canonical result."""
    spark.read.parquet(path).where(F.col("run_no") == run_no).drop("run_no").write.mode("overwrite").parquet(target)


def merge_config(defaults: Mapping, own: Mapping) -> dict:
    """Settings over defaults, nested mappings merged key by key."""
    out = dict(defaults)
    for key, value in own.items():
        out[key] = merge_config(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def resolve_path(path: str | Path, root: str | Path) -> Path:
    """An absolute path as it is, a relative one below the root."""
    path = Path(path)
    return path if path.is_absolute() else Path(root) / path


def load_config(path: str | Path | None, defaults: Mapping, root: str | Path, paths: str = "paths") -> dict:
    """Settings of a YAML or JSON file over the defaults, the entries of its ``paths`` resolved below the root; a named file has to exist."""
    found: Mapping = {}
    if path is not None:
        full = resolve_path(path, root)
        if not full.exists():
            raise FileNotFoundError(f"no settings at {full}")
        text = full.read_text(encoding="utf-8")
        if full.suffix == ".json":
            found = json.loads(text or "{}")
        else:
            import yaml

            found = yaml.safe_load(text) or {}
    config = merge_config(defaults, found)
    if isinstance(config.get(paths), Mapping):
        config[paths] = {k: str(resolve_path(v, root)) for k, v in config[paths].items()}
    return config


def constant_map(col: Column, values: Mapping[str, float]) -> Column:
    """Value of a constant map; null for keys it lacks."""
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out
