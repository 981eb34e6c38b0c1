"""Integrity audits: the database constraints, as queries returning the rows
that break them (Parquet enforces none of them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values held by more than one row: (cols..., n)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def duplicate_paths(inodes: DataFrame) -> DataFrame:
    """UNIQUE(owner_id, path) with a case-insensitive path."""
    return duplicate_keys(inodes.withColumn("lpath", F.lower("path")), ["owner_id", "lpath"])


def blank_names(inodes: DataFrame) -> DataFrame:
    """CHECK trim(name) <> '' (spaces only, as SQL trim)."""
    return inodes.where(F.trim(F.col("name")) == "").select("id", "name")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Rows whose non-NULL foreign key has no parent row."""
    return (child.where(F.col(fk).isNotNull())
            .join(parent.select(F.col(pk).alias(fk)), fk, "left_anti"))


def bad_enum(df: DataFrame, col: str, domain: list[str]) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(domain))


def null_violations(df: DataFrame, cols: list[str], key: str = "id") -> DataFrame:
    """(key, column) for every NOT NULL column that is NULL, in one scan."""
    empty = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda c: c.isNotNull())
    return df.select(F.col(key), F.explode(empty).alias("column"))


def bad_dimension(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Vectors whose width is not ``dim``."""
    return df.where(F.col(col).isNotNull() & (F.size(col) != dim))
