"""Sidecar indexes of message archives, product listings, error pages, cache keys: text into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small


def index_entries(lines: DataFrame, by: str = "file") -> DataFrame:
    """``message:offset:d=reference:parameter:level:forecast:`` lines: one entry each, ``last`` = byte before the next (null: to the end).

    ``code``: bad-index for lines that aren't entries and for offsets that come twice.
    """
    p = F.split("value", ":")
    t = lines.where(F.trim("value") != "").withColumn("p", p)
    ok = (F.size("p") >= 6) & F.get("p", F.lit(1)).rlike(r"^\d+$") & F.get("p", F.lit(2)).startswith("d=")
    e = t.select(by, F.get("p", F.lit(0)).alias("message"), F.when(ok, F.get("p", F.lit(1)).try_cast("bigint")).alias("start"), F.when(ok, F.substring(F.get("p", F.lit(2)), 3, 100)).alias("reference"), F.get("p", F.lit(3)).alias("parameter"), F.get("p", F.lit(4)).alias("level"), F.get("p", F.lit(5)).alias("forecast"))
    w = Window.partitionBy(by).orderBy("start")
    twice = F.count("*").over(Window.partitionBy(by, "start")) > 1
    return e.withColumn("last", F.lead("start").over(w) - 1).withColumn("code", F.when(F.col("start").isNull() | twice, "bad-index"))


def select_entries(entries: DataFrame, wanted: DataFrame, by: str = "file") -> DataFrame:
    """Entries that match the wanted (parameter, level, forecast) verbatim, once each; ``wanted`` without a match come with null bytes."""
    keys = ["parameter", "level", "forecast"]
    return small(wanted.distinct()).join(entries, keys, "left").dropDuplicates([by, "start", *keys])


LISTING = "total int, items array<struct<title:string,sourceId:string,format:string,downloadURL:string,boundingBox:struct<minX:double,maxX:double,minY:double,maxY:double>,publicationDate:string,sizeInBytes:bigint>>"


def products(docs: DataFrame) -> DataFrame:
    """Items of listing documents with a box; ``readable``: files that windows can be read from."""
    i = docs.select(F.explode(F.from_json("value", LISTING)["items"]).alias("i")).select("i.*").where("boundingBox is not null")
    return i.select("title", "sourceId", "downloadURL", F.col("boundingBox.minX").alias("west"), F.col("boundingBox.minY").alias("south"), F.col("boundingBox.maxX").alias("east"), F.col("boundingBox.maxY").alias("north"), F.try_to_timestamp("publicationDate").alias("published"), "sizeInBytes", F.lower("downloadURL").rlike(r"\.tiff?$").alias("readable"))


def footprint(west="west", south="south", east="east", north="north") -> Column:
    """A box to four decimals, as a key."""
    return F.concat_ws("|", *[F.format_string("%.4f", F.col(c)) for c in (west, south, east, north)])


def is_markup(text: str) -> Column:
    return F.lower(F.ltrim(text)).rlike(r"^(<!doctype|<html|<\?xml|<head|<body)")


def page_summary(html: str, limit: int = 300) -> Column:
    """Title and first paragraph without tags, at most ``limit`` characters."""
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    title = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    para = strip(F.regexp_extract(html, r"(?is)<p[^>]*>(.*?)</p>", 1))
    return F.substring(F.concat_ws(" - ", F.nullif(title, F.lit("")), F.nullif(para, F.lit(""))), 1, limit)


def redacted(url: str) -> Column:
    return F.regexp_replace(url, r"(?i)([?&](?:token|key|apikey|ref)=)[^&#]*", "$1***")


def cache_key(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)
