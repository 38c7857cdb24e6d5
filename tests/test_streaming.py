from __future__ import annotations

from datetime import UTC, datetime

from conftest import rows

from siteloom import schemas
from siteloom.operators import leads
from siteloom.operators.admission import admit_in_order
from siteloom.streaming.leads import LeadTable, admit_stream, merge_stream

KIND = schemas.LEAD + ", seq bigint"


def _lead(domain, name, email, seq, seen=datetime(2024, 1, 1, tzinfo=UTC), last=None):
    return (domain, f"https://{domain}/", name, None, [email] if email else [], [], None, [], None, None, None, seen, last or seen, seq)


def _write(spark, path, part, data):
    spark.createDataFrame(data, KIND).coalesce(1).write.mode("append").parquet(str(path))


def test_stream_equals_fold(spark, tmp_path):
    source, seen = tmp_path / "in", []
    first = [_lead("a.example", None, "x@a.example", 1), _lead("b.example", "B", None, 2), _lead("c.example", "C", None, 3, last=datetime(2023, 1, 1, tzinfo=UTC))]
    second = [_lead("a.example", "A", "y@a.example", 4), _lead("b.example", "BB", None, 5)]
    _write(spark, source, 0, first)
    table = LeadTable(spark, str(tmp_path / "out"))
    run = lambda: merge_stream(
        spark.readStream.schema(KIND).parquet(str(source)), table, str(tmp_path / "cp"), quarantine=str(tmp_path / "bad"), observer=lambda df, n: seen.append(n)
    ).awaitTermination()
    run()
    _write(spark, source, 1, second)
    run()
    run()  # nothing new: nothing changes
    good = [r for r in first + second if r[0] != "c.example"]
    assert rows(table.read().select("domain", "business_name", "emails")) == rows(leads.fold(spark.createDataFrame(good, KIND)).select("domain", "business_name", "emails"))
    assert spark.read.parquet(str(tmp_path / "bad")).first().domain == "c.example"
    assert seen == [0, 1]


def test_a_batch_is_applied_once(spark, tmp_path):
    table = LeadTable(spark, str(tmp_path / "t"))
    one, two = spark.createDataFrame([_lead("a.example", "A", None, 1)], KIND), spark.createDataFrame([_lead("b.example", "B", None, 1)], KIND)
    assert table.read().count() == 0
    table.replace(one, 0)
    table.replace(two, 0)
    assert [r.domain for r in table.read().collect()] == ["a.example"]
    table.replace(two, 1)
    assert [r.domain for r in table.read().collect()] == ["b.example"]


def test_admission_with_state(spark, tmp_path):
    kind = "crawl_id long, seq long, url string"
    source = str(tmp_path / "links")
    spark.createDataFrame([(1, 1, "https://e.com/a"), (1, 2, "https://e.com/a#x"), (2, 1, "https://e.com/a")], kind).coalesce(1).write.parquet(source)
    links = admit_stream(spark.readStream.schema(kind).parquet(source))
    target = str(tmp_path / "out")
    go = lambda: links.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    go()
    spark.createDataFrame([(1, 3, "https://www.e.com/a"), (1, 4, "https://e.com/b"), (1, 5, None)], kind).coalesce(1).write.mode("append").parquet(source)
    go()
    found = spark.read.parquet(target).select("crawl_id", "seq", "allowed", "reason")
    batch = admit_in_order(spark.read.schema(kind).parquet(source)).select("crawl_id", "seq", "allowed", "reason")
    assert rows(found) == rows(batch)
