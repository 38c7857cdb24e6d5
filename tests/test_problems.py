"""The catalogue reports every problem of a lead."""

from __future__ import annotations

from datetime import datetime

import duckdb
from conftest import rows
from pyspark.sql import functions as F

from siteloom.plans import catalogue


def test_problems_are_counted(spark, tmp_path):
    early, late = datetime(2024, 1, 1), datetime(2024, 5, 1)
    data = [
        (1, "https://a.com/", ["x@a.com"], [("+431234567", "+43 1 234567")], "homepage", early, late),
        (2, "https://b.com/", ["x@b.com"], [], "about", late, early),
        (3, "https://c.com/", [], [("12", "12")], "other", late, early),
        (4, "https://d.com/", None, None, None, None, None),
    ]
    kind = "lead_id long, website string, emails array<string>, phones array<struct<number: string, raw: string>>, page_type string, first_seen timestamp, last_seen timestamp"
    empty = [F.lit(None).cast("string").alias(c) for c in ("domain", "source_url", "business_name", "description", "language")]
    df = spark.createDataFrame(data, kind).select("*", *empty, F.lit(1).cast("long").alias("crawl_id"), F.col("first_seen").alias("created_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "page_leads.parquet"))
    found = catalogue.QUERIES["lead_problems"](spark, str(tmp_path)).select("problem", "leads")
    assert rows(found) == [("invalid phone number", 1), ("last_seen is earlier than first_seen", 2)]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW page_leads AS SELECT * FROM '{tmp_path}/page_leads.parquet/*.parquet'")
    assert sorted(duck.execute(catalogue.SQL["lead_problems"]).fetchall(), key=repr) == rows(found)
