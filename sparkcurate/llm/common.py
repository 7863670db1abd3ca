"""Helpers of the operators: table access, the word pattern, bound values, and registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.session import cut_lineage, small_batches, spread  # noqa: F401

#: A word everywhere in this package: a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the whole ``documents`` table."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns))


def own(name: str) -> str:
    """A column name that no input column has: inputs may carry any extra columns."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later steps neither recompute it nor lose it."""
    return cut_lineage(df)


def fold(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
