"""Scans of the stored inputs, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = "page_id bigint, url string, html string"
AUDIT = "seq bigint, ts string, tool string, outcome string, args map<string,string>, session string, page string, url string, replay struct<tool:string,args:map<string,string>>, replay_steps array<struct<tool:string,args:map<string,string>>>"


def read_pages_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Stored pages; a query that does not use ``html`` never reads it."""
    return spark.read.schema(PAGES).format(format).load(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the audit log; a malformed line gives a row of nulls that is left out."""
    return spark.read.schema(AUDIT).json(path).where("seq is not null")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
