"""Leads as a stream: pages come in, stored leads are merged batch by batch; links are admitted with state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteloom import schemas
from siteloom.functions.rules import DEFAULT, UrlRules
from siteloom.operators.admission import Gate
from siteloom.operators.leads import complete, fold, problems

Observer = Callable[[DataFrame, int], None]


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str) -> tuple[object, object]:
        place = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self._conf), place

    def names(self) -> list[str]:
        fs, place = self._at("")
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def read(self, name: str) -> str:
        fs, place = self._at(name)
        stream = fs.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file under another name first, so that it is there as a whole or not at all."""
        fs, draft = self._at(f"_draft-{name}")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        _, place = self._at(name)
        if fs.exists(place):
            fs.delete(place, False)
        if not fs.rename(draft, place):
            raise OSError(f"{place} can't be written")

    def drop(self, name: str) -> None:
        fs, place = self._at(name)
        fs.delete(place, True)


class LeadTable:
    """A table of leads in a folder of shared storage, in buckets by domain.

    A batch writes the buckets that it touches beside the old ones and then one small file that says which version of
    each bucket holds. That file is the commit: before it nothing has changed, after it everything has. The rest of the
    table isn't read. Versions that the last two commits don't name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets, self.folder = spark, path.rstrip("/"), buckets, Folder(spark, path)

    def _commits(self) -> list[int]:
        return sorted(int(n.removeprefix("commit-")) for n in self.folder.names() if n.startswith("commit-"))

    def _versions(self, batch: int | None) -> dict[str, int]:
        return {} if batch is None else json.loads(self.folder.read(f"commit-{batch}"))

    def version(self) -> int | None:
        """The batch that was committed last."""
        return max(self._commits(), default=None)

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All leads, or those of some buckets."""
        held = self._versions(self.version())
        wanted = held if buckets is None else {str(b) for b in buckets} & held.keys()
        paths = [f"{self.path}/v{held[b]}/bucket={b}" for b in sorted(wanted, key=int)]
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], schemas.LEAD)

    def _schema(self) -> object:
        return self.spark.createDataFrame([], schemas.LEAD).schema

    def bucket(self, domain: str = "domain") -> Column:
        return F.pmod(F.xxhash64(domain), F.lit(self.buckets)).cast("int")

    def replace(self, leads: DataFrame, batch: int, buckets: Iterable[int] | None = None) -> None:
        """Commit ``leads`` as the contents of ``buckets`` (all by default); a batch is committed once."""
        commits = self._commits()
        if commits and commits[-1] >= batch:
            return
        held = self._versions(commits[-1] if commits else None)
        touched = range(self.buckets) if buckets is None else buckets
        rows = leads.select(*schemas.LEAD_COLUMNS, self.bucket().alias("bucket")).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{batch}")
        written = {int(n.removeprefix("bucket=")) for n in Folder(self.spark, f"{self.path}/v{batch}").names() if n.startswith("bucket=")}
        kept = {b: v for b, v in held.items() if int(b) not in set(touched)}
        self.folder.write(f"commit-{batch}", json.dumps(kept | {str(b): batch for b in touched if b in written}))
        self._clean(commits, held, batch)

    def _clean(self, commits: list[int], held: dict[str, int], batch: int) -> None:
        """Remove what neither this commit nor the one before it names."""
        for old in commits[:-1]:
            before = self._versions(old)
            for bucket, version in before.items():
                if held.get(bucket) != version:
                    self.folder.drop(f"v{version}/bucket={bucket}")
            self.folder.drop(f"commit-{old}")

    def merge(self, sightings: DataFrame, batch: int) -> None:
        """Fold ``sightings`` (leads with ``seq``) into the buckets of their domains."""
        touched = [r["b"] for r in sightings.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        stored = self.read(touched).withColumn("seq", F.lit(-1).cast("bigint"))
        self.replace(fold(stored.unionByName(sightings)), batch, touched)


def merge_stream(
    sightings: DataFrame, table: LeadTable, checkpoint: str, *, sequence: str = "seq", quarantine: str | None = None, observer: Observer | None = None, once: bool = True, validate: bool = True,
    pages: Observer | None = None,
) -> StreamingQuery:
    """Merge a stream of page leads into ``table``: what is stored stays, open fields are filled.

    A micro-batch is the unit that is applied or not; after a failure it is applied again with the same
    number and changes nothing twice. Rows with problems go to ``quarantine``. ``sequence`` is the order of
    arrival, so the result equals the fold of all rows in that order if batches come in order. Rows that
    were checked before come in with ``validate=False``. ``pages`` stores the pages of the same batch with its number;
    like the leads it must change nothing when the batch comes again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = complete(batch)
        judged = problems(rows).persist() if validate else rows.withColumn("problems", F.array().cast("array<string>"))
        try:
            if quarantine:
                bad = judged.filter("size(problems) > 0")
                bad.withColumn("batch", F.lit(number)).write.mode("append").parquet(quarantine)
            good = judged.filter("size(problems) = 0").select(*schemas.LEAD_COLUMNS, F.col(sequence).cast("bigint").alias("seq"))
            table.merge(good, number)
            if pages:
                pages(judged, number)
            if observer:
                observer(judged, number)
        finally:
            judged.unpersist()

    writer = sightings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def admit_stream(links: DataFrame, *, rules: UrlRules = DEFAULT, crawl_id: str = "crawl_id", seq: str = "seq", url: str = "url") -> DataFrame:
    """Decisions on a stream of links, with the state of each crawl kept between batches.

    Within a batch links are taken in order of ``seq``. The state holds the admitted pages of a crawl.
    """
    state = "seen array<string>, variants map<string,array<string>>, calendar map<string,array<string>>"
    out = "crawl_id long, seq long, allowed boolean, raw string, url string, reason string, detail string"

    def admit(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(rules)
        if held.exists:
            seen, variants, calendar = held.get
            gate.seen = set(seen)
            for target, stored in ((gate.variants.members, variants), (gate.calendars.members, calendar)):
                for k, v in (stored.items() if isinstance(stored, dict) else stored):
                    target[k] = set(v)
        rows = pd.concat(list(frames)).sort_values("seq")
        found = [(key[0], n, *gate.admit(raw)) for n, raw in zip(rows["seq"], rows["url"]) if raw is not None]
        held.update((sorted(gate.seen), {k: sorted(v) for k, v in gate.variants.members.items()}, {k: sorted(v) for k, v in gate.calendars.members.items()}))
        yield pd.DataFrame(found, columns=["crawl_id", "seq", "allowed", "raw", "url", "reason", "detail"])

    rows = links.select(F.col(crawl_id).cast("long").alias("crawl_id"), F.col(seq).cast("long").alias("seq"), F.col(url).alias("url"))
    return rows.groupBy("crawl_id").applyInPandasWithState(admit, out, state, "append", GroupStateTimeout.NoTimeout)
