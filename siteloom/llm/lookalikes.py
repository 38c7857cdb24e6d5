"""Bringing visually identical text to one form (problem 4).

The transducer of ``forms`` reads text by grapheme clusters and writes the usual form in one pass. Its table is
compiled from rules and checked for conflicts, look-alike letters and Persian letters by the script of the word
included; longer clusters win over their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.encoding import find_garbled, values_of
from siteloom.llm.forms import unify
from siteloom.llm.residue import host_of
from siteloom.session import spread, table


def unified(column: Column) -> Column:
    """A column in its usual form; nulls stay null. Narrow, whole values."""

    @F.pandas_udf("string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(unify, na_action="ignore")

    # ASCII values, most of a corpus, never leave the JVM's side unchanged.
    return F.when(column.rlike(r"[^\x00-\x7f]"), forms(column)).otherwise(column)


def find_lookalikes(values: DataFrame, garbled: DataFrame | None = None) -> DataFrame:
    """``(table_name, row_id, field_name, text, form)`` of values that aren't in their usual form.

    ``values`` are rows ``(table_name, row_id, source, field_name, text)``; those in ``garbled`` (the first,
    second and fourth of these columns) are left out. Null, empty and ASCII values never come out,
    repeated rows do once.
    """

    @F.pandas_udf("string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(unify, na_action="ignore")

    foreign = values.filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    # Marked so that the filter on the form doesn't run the function a second time.
    changed = foreign.withColumn("form", forms.asNondeterministic()("text")).filter(F.col("form") != F.col("text"))
    found = changed.select("table_name", "row_id", "field_name", "text", "form").distinct()
    if garbled is not None:
        keys = ["table_name", "row_id", "field_name"]
        found = found.join(garbled.select(*keys).distinct(), keys, "left_anti")
    return found


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = spread(table(spark, sf_dir, "page_leads").select("lead_id", "business_name", "description", "website"))
    pages = spread(table(spark, sf_dir, "website_metadata").select("metadata_id", "og_title"))
    of_leads = values_of(leads, "page_leads", "lead_id", host_of(F.col("website")), ["business_name", "description"])
    of_pages = values_of(pages, "website_metadata", "metadata_id", F.lit(None).cast("string"), ["og_title"])
    names = of_leads.filter(F.col("field_name") == "business_name")
    return find_lookalikes(of_leads.unionByName(of_pages), find_garbled(names))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, titles and descriptions with characters that stand in for, or are added to, the usual ones."""
    return _found(spark, sf_dir).select("table_name", "row_id", "field_name").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values with their usual form."""
    return _found(spark, sf_dir)


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
SQL: dict[str, str] = {}
