"""Readers for the shared Parquet tables and small constant tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One source table.  Column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def match_rules(spark: SparkSession, rows=None) -> DataFrame:
    """The rule table (a handful of configuration rows)."""
    rows = rows if rows is not None else S.DEFAULT_RULES
    data = [(rid, name, rtype, __import__("decimal").Decimal(tol), win, prio, True)
            for rid, name, rtype, tol, win, prio in rows]
    return spark.createDataFrame(data, S.MATCH_RULES)


def import_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.IMPORT_SOURCES, S.IMPORT_SOURCE)


def sla_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.SLA_HOURS.items()), S.SLA_RULES)


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.ROLES.items()), "role_id int, role_name string")


def empty_like(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def as_timestamp(c: str):
    """Parquet ``timestamp_ntz`` -> session (UTC) timestamp."""
    return F.col(c).cast("timestamp")
