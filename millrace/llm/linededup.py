"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is the text between line feeds, without spaces, tabs and carriage returns at its ends. For each host, the pages that contain a line are
counted once each and divided by the host's pages; lines on more than `ratio` of them are dropped wherever they stand on that host. A line on one page alone isn't
boilerplate, however few pages its host has, so `least` is 2 pages. Such lines are at most (mean lines of a page) / ratio for each host, whatever the host's size.

Blank lines are neither counted nor dropped. Rows without a host lose nothing. Null texts stay null. Repeated rows are pages of their own. An empty table gives an empty result.
A page all of whose lines go keeps its row with an empty text. Other columns, whatever their names, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unused, written

#: Above so many lines to be dropped in all, they are joined by host instead of being broadcast.
MOST_BROADCAST = 100_000


def _bare(line):
    return F.btrim(line, F.lit(" \t\r"))


def _key(line):
    return F.md5(_bare(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least: int) -> DataFrame:
    """host, lines (MD5 of the lines to be dropped), n."""
    of = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("__host"), F.split(text, "\n", -1).alias("__lines"))
    keys = F.array_distinct(F.transform(F.filter("__lines", lambda x: _bare(x) != ""), _key))
    counts = of.select("__host", F.explode(keys).alias("__line")).groupBy("__host", "__line").agg(F.count("*").alias("__on")).where(F.col("__on") >= least)
    totals = of.groupBy("__host").agg(F.count("*").alias("__pages"))
    frequent = counts.join(totals, "__host").where(F.col("__on") > F.lit(float(ratio)) * F.col("__pages"))
    return frequent.groupBy("__host").agg(F.collect_list("__line").alias("__drop"))


def drop_boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.10, least: int = 2) -> DataFrame:
    """The pages with boilerplate lines taken out of `text`; all columns stay, in order."""
    drop = written(boilerplate(pages, host, text, ratio, least), "boilerplate")
    size = drop.agg(F.coalesce(F.sum(F.size("__drop")), F.lit(0))).first()[0]
    of, lines = (unused(x, pages.columns) for x in ("host_of_lines", "lines_to_drop"))
    drop = drop.select(F.col("__host").alias(of), F.col("__drop").alias(lines))
    if size <= MOST_BROADCAST:
        drop = F.broadcast(drop)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: (_bare(x) == "") | ~F.array_contains(F.col(lines), _key(x))), "\n")
    joined = pages.join(drop, F.col(host) == F.col(of), "left")
    return joined.select(*[F.when(F.col(lines).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in pages.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT source, k, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS k FROM d WHERE source IS NOT NULL) WHERE k <> '' GROUP BY source, k),
t AS (SELECT source, count(*) AS n FROM d GROUP BY source),
b AS (SELECT c.source, list(c.k) AS ks FROM c JOIN t ON c.source = t.source WHERE c.n >= 2 AND c.n > CAST(0.10 AS DOUBLE) * t.n GROUP BY c.source)
SELECT d.doc_id, d.source, CASE WHEN b.ks IS NULL OR d.text IS NULL THEN d.text ELSE array_to_string(list_filter(d.ls, lambda x: NOT list_contains(b.ks, trim(x, ' ' || chr(9) || chr(13)))), chr(10)) END AS text
FROM d LEFT JOIN b ON d.source = b.source
"""
