"""Reading tables of fetched pages, stored tables and exported leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import columns as C

FETCHED = (
    "crawl_id bigint, seq bigint, url string, final_url string, depth int, parent_url string, outcome string, http_status int, content_type string, "
    "charset string, body binary, fetched_at timestamp"
)


def fetched(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Fetched pages from files of a known schema, so that no file is read to infer one."""
    return spark.read.schema(FETCHED).format(kind).load(path)


def parsed(pages: DataFrame) -> DataFrame:
    """Pages with ``page``, everything that is read from their body. What can't be a page is filtered before any parsing."""
    media = C.media_type("content_type")
    candidates = pages.filter((F.col("outcome") == "ok") & (F.octet_length("body") > 0) & (media.isNull() | media.isin("text/html", "application/xhtml+xml")))
    url = F.coalesce("final_url", "url")
    return candidates.withColumn("page", C.parsed_response("outcome", "body", "content_type", "charset", url)).filter("page IS NOT NULL").drop("body")


def links(pages: DataFrame, *, html: str = "html", url: str = "url") -> DataFrame:
    """``(url, position, href, base_url)``: the links of pages to follow, in order."""
    held = pages.select(F.col(url).alias("url"), C.page_links(html, url).alias("l"))
    return held.select("url", F.col("l.base_url").alias("base_url"), F.posexplode("l.hrefs").alias("position", "href"))


def leads(spark: SparkSession, path: str) -> DataFrame:
    """Leads from JSON lines as the bulk export writes them."""
    return spark.read.schema(schemas.LEAD).json(path)


def stored_leads(spark: SparkSession, path: str) -> DataFrame:
    """Leads from a stored table."""
    return spark.read.parquet(path)
