"""Every query with SQL gives the same rows as DuckDB on the smallest data, and every other one runs."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import pytest
from conftest import DATA

from siteloom import cli
from siteloom.plans import catalogue

if not DATA.exists():
    pytest.skip("no test data here", allow_module_level=True)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime) else value


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(DATA))
    got = _table(found.columns, found.collect())
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        assert got == _table([c[0] for c in cursor.description], cursor.fetchall())


def test_plans_have_no_products(spark):
    for name in ("url_dedupe_groups", "crawl_state_report", "crawl_resume_promote", "lead_dedupe_fold", "lead_conflicts", "gate_rejection_counts"):
        plan = catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = catalogue.QUERIES["url_hash"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,crawl_id:bigint,url:string,url_hash:string>" in plan


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == ["domain", "emails", "phones", "first_seen", "last_seen", "votes"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    catalogue._folded(spark, str(DATA)).write.parquet(str(tmp_path / "t"))
    assert cli.main(["search", str(tmp_path / "t"), "--language", "en", "--has-email", "--page", "1", "--page-size", "2"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["export", str(tmp_path / "t"), "--format", "csv", "--output", str(tmp_path / "x.csv"), "--no-email"]) == 0
    assert (tmp_path / "x.csv").read_text(encoding="utf-8").startswith("business_name,")
    assert cli.main(["export", str(tmp_path / "t"), "--format", "xml"]) == 2
    assert cli.main(["list", str(tmp_path / "t"), "--sort-by", "colour"]) == 2
    assert cli.main(["crawl-state", str(DATA / "crawls.parquet"), str(DATA / "crawl_pages.parquet"), "--json"]) == 0
