"""Helpers that the operators share: tables in the shared folder, row keys, clashing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.plans.tables import discard, materialize

__all__ = ["WORD", "discard", "hex_unit", "id_text", "materialize", "table", "unit", "unused", "without"]

#: Words of the contracts: maximal runs of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: where names clash, the operator's column replaces the input's."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def id_text(doc_id: str | Column = "doc_id") -> Column:
    """The id as text; a null id reads 'null'."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(c.cast("string"), F.lit("null"))


def unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) from the md5 of the parts; DuckDB computes the same."""
    return hex_unit(F.md5(F.concat(*parts).cast("binary")), 0)


def hex_unit(digest: Column, k: int) -> Column:
    """The k-th 32 bits of an md5 digest as a number in (0, 1)."""
    return (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
