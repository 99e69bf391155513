"""Readers for the given parquet tables and the directory tables (O-01, O-02)."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rollcall.sources import schemas as S


def missing_path(exc: AnalysisException) -> bool:
    """Whether a read failed only because nothing was written there yet."""
    return exc.getCondition() == "PATH_NOT_FOUND"


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with its declared schema (never inferred)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = S.BASE_TABLES.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """O-01: scan a stored profile snapshot with its declared schema; a missing ``avatar_url`` is NULL (O-05)."""
    return spark.read.schema(S.USERS).parquet(path)


def read_auth_users(spark: SparkSession, path: str) -> DataFrame:
    """O-02: scan a stored identity snapshot."""
    return spark.read.schema(S.AUTH_USERS).parquet(path)
