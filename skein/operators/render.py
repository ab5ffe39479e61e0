"""Digest rendering: text and HTML blocks for each source, then one message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape


def text_blocks(rows: DataFrame, counts: DataFrame, source: str, order: str, line: str) -> DataFrame:
    """(source, block): a heading with the source's count and a dash line a row, in order."""
    body = rows.groupBy(source).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("_l"))
    body = body.join(counts, source)
    lines = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("- "), x[line])), "\n")
    return body.select(source, F.concat(F.lit("["), F.col(source), F.lit("] "), F.col("n").cast("string"), F.lit("\n"), lines).alias("block"))


def card(title: Column, url: Column, date: Column, kind: Column, content: Column) -> Column:
    """A post's card: escaped title and link, date, and the block of its kind."""
    inner = F.when(kind == "none", "").otherwise(F.concat(F.lit('<div class="'), kind, F.lit('">'), html_escape(content), F.lit("</div>")))
    return F.concat(F.lit('<li><a href="'), html_escape(url), F.lit('">'), html_escape(title), F.lit("</a> <span>"), html_escape(date), F.lit("</span>"), inner, F.lit("</li>"))


def html_blocks(cards: DataFrame, source: str, order: str, html: str) -> DataFrame:
    """(source, block): the cards of each source in order under its name and count."""
    g = cards.groupBy(source).agg(F.array_sort(F.collect_list(F.struct(order, html))).alias("_c"))
    return g.select(source, F.concat(F.lit("<h2>"), html_escape(source), F.lit(" ("), F.size("_c").cast("string"), F.lit(")</h2><ul>"), F.array_join(F.transform("_c", lambda x: x[html]), ""), F.lit("</ul>")).alias("block"))


def message(blocks: DataFrame, source: str, notice: Column, subject: str) -> DataFrame:
    """One row (subject, html): all blocks by source, with a notice if ``notice`` holds for any."""
    out = blocks.agg(F.array_sort(F.collect_list(F.struct(source, "block"))).alias("_b"), F.bool_or(notice).alias("_n"))
    body = F.array_join(F.transform("_b", lambda x: x["block"]), "\n")
    return out.select(F.lit(subject).alias("subject"), F.concat(F.lit("<html><body>"), body, F.when(F.col("_n"), "<p>AI summaries may be wrong.</p>").otherwise(""), F.lit("</body></html>")).alias("html"))


def subject(top: Column, top_n: Column, others: Column, total: Column) -> Column:
    rest = F.when(others > 0, F.concat(F.lit(" +"), others.cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("["), total.cast("string"), F.lit("] "), top, F.lit(" ("), top_n.cast("string"), F.lit(")"), rest)


def summary_label(n: Column) -> Column:
    """The heading of a summary block by its number of lines."""
    return F.when(n > 0, F.concat(F.lit("AI "), n.cast("string"), F.lit(" lines"))).otherwise("")
