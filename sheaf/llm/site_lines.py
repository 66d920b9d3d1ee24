"""Line dedup by site-relative frequency (operator 2). DataFrame functions only.

A page's lines are those of its visible text: block tags and line breaks part them. Pages are
grouped by host; the pages of a host that contain a line, divided by the host's pages, is the
line's ratio. Lines with a ratio above ``most`` on at least ``least_pages`` pages are
boilerplate of that host and dropped from its pages.

Lines travel as hashes. A page counts a line once, and counts are combined on the map side, so
neither a host with a third of all pages nor a line on all of them is a hot key there; in the
join that finds the pages again a host's line is one row, and adaptive execution splits the
other side. The text is joined once, by page.

Defined results: null and empty pages have no lines; pages with a null url or one without a
host keep all lines and count for no host; hosts are compared in lower case without port and
user. A ratio of exactly ``most`` stays. Repeated rows count as pages of their own, but rows
that share a page_id are dropped alike, and rows with a null page_id count but keep all lines.
An empty table gives no rows. Pages of any length are handled whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li"
    r"|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
TAGS = "<[^>]*>"
EDGES = r"^[ \t\r\f]+|[ \t\r\f]+$"


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines(html: Column) -> Column:
    """The lines of a page's visible text, trimmed, without empty ones."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, "")
    parts = F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, EDGES, ""))
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda line: line != "")


def hashes(found: Column) -> Column:
    return F.transform(found, lambda line: F.xxhash64(line))


def drop_boilerplate(pages: DataFrame, most: float = 0.3, least_pages: int = 3) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text left, of every page (page_id, url, html)."""
    split = stored(pages.select("page_id", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines")), "lines")
    known = split.filter("host IS NOT NULL")
    seen = known.select("page_id", "host", F.explode(F.array_distinct(hashes(F.col("lines")))).alias("line"))
    totals = known.groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    boilerplate = counts.join(totals, "host").filter(F.col("n") > F.lit(most) * F.col("pages")).select("host", "line")
    # Rows without an id keep their lines; they are not gathered in one group.
    gone = seen.filter("page_id IS NOT NULL").join(boilerplate, ["host", "line"]).groupBy("page_id").agg(F.collect_set("line").alias("gone"))
    kept = F.filter("lines", lambda line: ~F.coalesce(F.array_contains("gone", F.xxhash64(line)), F.lit(False)))
    return (
        split.join(gone, "page_id", "left")
        .withColumn("kept", F.when(F.col("host").isNull(), F.col("lines")).otherwise(kept))
        .select(
            "page_id",
            "host",
            F.size("lines").alias("n_lines"),
            (F.size("lines") - F.size("kept")).alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))
