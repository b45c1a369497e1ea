"""Operator 10: line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. The pages of a host that contain a line, divided by the pages of the host, give the line's
ratio there; lines above the boilerplate ratio, on at least LEAST pages, are dropped from that host's pages. Copies of
a page count once, so that a host with many copies of one page doesn't lose that page's own lines.

Cases: null and empty texts have no lines; blank lines are never boilerplate; a null host is a host of its own; rows
with equal ids are told apart, equal rows give equal results; an empty table gives no rows; a line that occurs twice
on a page counts one page and goes twice. Only the named columns are read, all others are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Share of a host's pages above which a line is boilerplate, and pages it must be on at least.
RATIO, LEAST = 0.1, 3
#: The share for sources of documents. A source is far wider than a host, so passages that repeat are on a few percent of it.
DOCUMENT_RATIO = 0.01

#: Elements that end a line in a page, and those whose content is no text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|title|tr|ul"
UNSEEN = "(?is)<!--.*?(?:-->|\\z)|<(script|style)\\b.*?(?:</\\1\\s*>|\\z)"


def text_lines(text: Column) -> Column:
    """The trimmed lines of a plain text; null: none."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: inside higher-order functions, a named column would be repeated."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def tags_replaced(text: Column, tag: str, by: str) -> Column:
    """The text with every tag replaced. Tags end with ">", so what follows the last one has none and isn't searched:
    a search that meets no end would go over the rest of the text again at every start."""
    def cut(x: Column) -> Column:
        tail = F.substring_index(x, ">", -1)
        return F.concat(F.regexp_replace(F.substring(x, F.lit(1), F.length(x) - F.length(tail)), tag, by), tail)

    return let(text, lambda x: F.when(F.contains(x, F.lit(">")), cut(x)).otherwise(x))


def page_lines(html: Column) -> Column:
    """The trimmed lines a browser would show, tags removed; null: none. An unclosed comment or script goes on to the end."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "\n")
    lines = F.split(tags_replaced(seen, f"(?i)</?(?:{BLOCKS})\\b[^>]*>", "\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(tags_replaced(x, "<[^>]*>", ""))), lambda x: x != "")


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, key, n_pages, host_pages of the lines to drop. pages: host, page (hash of its content), keys (of its lines)."""
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least)
    totals = totals.withColumnRenamed("host", "of")
    joined = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return joined.where(F.col("n_pages") > ratio * F.col("host_pages"))


def drop_lines(df: DataFrame, host: Column, lines: Column, ratio: float = RATIO, least: int = LEAST, cut_again: bool = False) -> DataFrame:
    """df with _lines (those kept), _n_lines and _n_dropped added.

    The keys of the lines, not their text, go through the shuffles that find boilerplate; the lines to drop come back
    as one array of keys for each distinct page. cut_again: the lines are made anew from df's columns after that join
    instead of moving beside them.
    """
    rows = df.select("*", host.alias("_host"), lines.alias("_all"))
    rows = rows.withColumn("_keys", F.transform(F.filter("_all", lambda x: x != ""), line_key)).withColumn("_page", F.xxhash64(F.array_join("_all", "\n")))
    keyed = written(rows.select(F.col("_host").alias("host"), F.col("_page").alias("page"), F.col("_keys").alias("keys")).distinct(), "line-keys")
    drop = written(boilerplate(keyed, ratio, least), "line-boilerplate")
    hits = keyed.select("host", "page", F.explode(F.array_distinct("keys")).alias("key"))
    gone = drop.select(F.col("host").alias("at"), F.col("key").alias("k"))
    hits = hits.join(gone, F.col("host").eqNullSafe(F.col("at")) & (F.col("key") == F.col("k")), "left_semi")
    by_page = hits.groupBy(F.col("host").alias("_of"), F.col("page").alias("_on")).agg(F.collect_set("key").alias("_gone"))
    if cut_again:
        rows = rows.drop("_all", "_keys")
    joined = rows.join(by_page, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("_page") == F.col("_on")), "left")
    if cut_again:
        joined = joined.withColumn("_all", lines)
    none = F.array().cast("array<bigint>")
    kept = F.filter("_all", lambda x: ~F.array_contains(F.coalesce("_gone", none), line_key(x)) | (x == ""))
    out = joined.withColumn("_lines", F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(kept))
    return out.withColumn("_n_lines", F.size("_all").cast("long")).withColumn("_n_dropped", (F.size("_all") - F.size("_lines")).cast("long"))


def page_host(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def page_line_dedup(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, host, n_lines, n_dropped, text (the lines kept) for every page."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = drop_lines(own, page_host(F.col("url")), page_lines(F.col("html")), ratio, least)
    return out.select(F.col("id").alias(id_col), F.col("_host").alias("host"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.array_join("_lines", "\n").alias("text"))


def document_line_dedup(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, source_col: str = "source", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, without boilerplate lines of their source; length_col is counted anew."""
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = drop_lines(own, F.col(f"row.{source_col}"), text_lines(F.col(f"row.{text_col}")), ratio, least, cut_again=True)
    text = F.when(F.col("_n_dropped") > 0, F.array_join("_lines", "\n")).otherwise(F.col(f"row.{text_col}"))
    values = {text_col: text} | ({length_col: F.length(text).cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*[values.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])
