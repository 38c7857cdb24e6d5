"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", **conf: object) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siteloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than there are cores.

    Only meant before Python work that costs far more than moving the rows. A scan of a large
    table has many splits and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; a private one only where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siteloom-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared storage that checkpoints go to."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there, so a lost executor costs no rework upstream."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``df`` with the number of each row within its group, from 1, in order.

    Rows are sorted by ranges and counted by partition, so a group of any size is spread over all tasks; only counts of
    groups by partition come together. Rows that tie have some order.
    """
    by = [F.col(c) for c in (*group, *order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("__part", F.shiftright("__at", 33)))
    spans = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    earlier = F.sum("__rows").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("__before", F.coalesce(earlier, F.lit(0))).drop("__rows")
    spans = spans.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__part").alias("__p"), "__first", "__before")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    joined = placed.join(spans, same).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1)
    return joined.select(*df.columns, name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that they need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_siteloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siteloom-")) / "siteloom.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._siteloom_shipped = True
