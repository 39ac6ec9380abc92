"""Line dedup by site-relative frequency.

Pages are grouped by host; for each line the pages of the host that contain it are
divided by the pages of the host, and lines above `ratio` are boilerplate and go.
A page counts once for a line, however often it repeats it, and a line has to stand
on two pages to be a repetition at all.

A host of P pages with L distinct lines a page on average has at most L / ratio
boilerplate lines, whatever P is, so these are carried as one array per host, and
the cleaned page is made in place: no line is moved twice and no page reassembled.
A page's own lines are looked up in that array by hash, so a very long page costs
what its lines cost. The arrays are broadcast if they are small in bytes, else
joined by host, where the engine splits a host with many pages.
Counting is combined on the map side by (host, line), which no single host or line
can overload.

Edge cases: null url is the host ''; null html has no lines; rows that repeat a
page count as pages; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import materialise, small

RATIO = 0.3
#: Patterns are held to what RE2 and Java read alike.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)<br[^>]*>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title)(?:\s[^>]*)?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html):
    """Non-empty trimmed lines of a page's visible text."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAKS, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(lines: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, lines) -> (host, drop: array of boilerplate lines)."""
    pages = lines.groupBy("host").agg(F.count("*").alias("pages"))
    counts = lines.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return (
        counts.filter("n > 1")
        .join(pages, "host")
        .filter(F.col("n") / F.col("pages") > ratio)
        .groupBy("host")
        .agg(F.collect_list("line").alias("drop"))
    )


def clean(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """One row per page: page_id, host, lines kept (array), n_lines, n_dropped."""
    lines = materialise(
        pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), lines_of(F.col(f"`{html_col}`")).alias("lines")), "site-lines"
    )
    drop = small(materialise(boilerplate(lines, ratio), "site-boilerplate"), 20_000)
    kept = F.when(F.size("own") > 0, F.filter("lines", lambda x: ~F.array_contains(F.col("own"), x))).otherwise(F.col("lines"))
    return (
        lines.join(drop, "host", "left")
        .withColumn("own", F.array_intersect("lines", "drop"))
        .withColumn("kept", kept)
        .select("page_id", "host", F.col("kept").alias("lines"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
    )
