"""Shared helpers: durable intermediate tables, text normalisation, sampling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that
    setting (a test) gets a temporary folder, which then is kept in the session; a cluster without it is
    refused, as its executors would not see the driver's folder.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


_MADE: list[list[str]] = []


@contextmanager
def made_tables() -> Iterator[list[str]]:
    """Paths that :func:`new_path` gives out within the block, so that its tables can be removed once they aren't read any more."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor costs a re-read of files, never a re-run of what made them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`materialise`, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(rows: int = 1000) -> None:
    """Lower the session's rows an Arrow batch to ``rows``: texts are long, and a batch is held several times over by the JVM and the worker."""
    spark = SparkSession.active()
    now = int(spark.conf.get(BATCH_KEY, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_KEY, str(rows))


def crc_mod(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the fold of a row."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def hash_sample(df: DataFrame, id_col: str, at_most: int, salt: int = 0, total: int | None = None) -> DataFrame:
    """A deterministic sample of about ``at_most`` rows (the documented bound), chosen by a hash of the id.

    Used only to fit classifiers. One count of rows (or ``total``, from a frame that reads fewer columns)
    fixes the rate; rows are then picked map-side.
    """
    total = df.count() if total is None else total
    if total <= at_most:
        return df
    cut = int(at_most / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30)) < cut)


def at_most_rows(df: DataFrame, rows: int, *key_cols: str) -> DataFrame:
    """The first ``rows`` rows in the order of a hash of the key columns: a hard bound where a sampled id repeats."""
    return df.orderBy(F.xxhash64(*key_cols)).limit(rows)


def in_fold(id_col: str | Column, modulus: int, fold: int) -> Column:
    """Whether a row's fold is ``fold``; a null id is in none."""
    return F.coalesce(crc_mod(id_col, modulus) == fold, F.lit(False))


def utf8_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8").lower().split()
