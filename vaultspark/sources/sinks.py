"""Writing: upserts, replaced partitions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: list[Column] | None = None) -> DataFrame:
    """The old rows whose key is not new, and of the new rows of each key the last by order (any one without an order)."""
    if order:
        w = Window.partitionBy(key).orderBy(*(o.desc() for o in order))
        new = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_file(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ("patient_id", "file_path")) -> DataFrame:
    """The old rows of other files, and the new rows: no tails of an earlier, longer version stay."""
    return old.join(new.select(*by).distinct(), list(by), "left_anti").unionByName(new, allowMissingColumns=True)


def update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the values that changes give for their key; a null leaves a value as it is."""
    named = changes.select(key, *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    met = rows.join(named, key, "left")
    return met.select(*(F.coalesce(f"__{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in rows.columns))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions that the rows belong to, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report with a header and the columns in this order; those that are absent are empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
