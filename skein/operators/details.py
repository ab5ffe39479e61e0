"""Detail scans: what a post gains from its own page."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html as H
from ..sources import post_dates as P
from . import classify


@dataclass(frozen=True)
class DetailRules:
    """Where a board's pages hold what: ``bodies`` and ``scopes`` (of dates) are
    selectors, the first that finds something counts; ``files`` are parts of file
    URLs; a post whose URL has a part of ``direct`` is a file itself; ``labels``
    name the values that are wanted all or not at all; of these, ``titled`` may
    be the post's title and ``dated`` its date."""

    bodies: tuple[str, ...] = (".board-view-wrap .body", ".board-view-wrap .cont", ".view-cont", "#content")
    scopes: tuple[str, ...] = P.DETAIL_SCOPES
    files: tuple[str, ...] = ("filedown", "getfile", "/file")
    direct: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    titled: str = ""
    dated: str = ""
    dates: P.DateRules = field(default_factory=lambda: P.KOREAN_DATES)


PARTS = f"struct<body:string,dates:{P.CANDIDATES},labels:array<struct<label:string,value:string>>,files:array<struct<name:string,url:string>>>"


def read_page(page: str | None, base: str, rules: DetailRules) -> dict:
    """The parts of one page: body text, date candidates, wanted labels, files by URL."""
    root = H.parse(page)
    body = H.first_of(root, rules.bodies)
    files: dict[str, str] = {}
    for a in root.find_all("a"):
        href = a.attrs.get("href", "")
        if any(x in href.lower() for x in rules.files):
            url = urljoin(base, href)
            files.setdefault(url, H.file_name(a, url, "attachment"))
    values = H.label_values(page) if rules.labels else {}
    return {
        "body": H.clean(body.text("\n")) if body else "",
        "dates": [c for s in rules.scopes for scope in H.select(root, s) for c in P.candidates(scope, rules.dates)],
        "labels": [{"label": x, "value": values.get("".join(x.split()), "")} for x in rules.labels],
        "files": [{"name": n, "url": u} for u, n in files.items()],
    }


def parts_udf(rules: DetailRules):
    @F.pandas_udf(PARTS)
    def run(page: pd.Series, base: pd.Series) -> pd.DataFrame:
        made = [read_page(p, b or "", rules) for p, b in zip(page, base, strict=True)]
        return pd.DataFrame({k: pd.Series([m[k] for m in made], dtype=object) for k in ("body", "dates", "labels", "files")})

    return run


def add_files(have: Column, more: Column) -> Column:
    """Files (name, url) of both, those whose URL is there already left out."""
    urls = F.transform(have, lambda x: x["url"])
    return F.concat(have, F.filter(more, lambda x: ~F.array_contains(urls, x["url"])))


def found(body: Column, details: Column, files: Column) -> Column:
    """Whether a detail scan brought anything."""
    return (F.trim(F.coalesce(body, F.lit(""))) != "") | (F.size(details) > 0) | (F.size(files) > 0)


def detail_scan(posts: DataFrame, pages: DataFrame, rules: DetailRules) -> DataFrame:
    """``posts`` (url, title, date, files: array of (name, url)) with body,
    details, date, files and ``found``; ``pages`` has (url, html), once a URL.

    A date that is there stays.  With all wanted labels the body stays empty.  A
    post without a page gains nothing.
    """
    none = F.expr("cast(array() as array<struct<label:string,value:string>>)")
    direct = F.lit(False)
    for x in rules.direct:
        direct = direct | F.lower("url").contains(x)
    out = posts.withColumn("_direct", direct).withColumn("_url", F.when(~F.col("_direct"), F.col("url")))
    out = out.join(pages.select(F.col("url").alias("_url"), F.col("html").alias("_html")), "_url", "left")
    out = out.withColumn("_p", F.when(F.col("_html").isNotNull(), parts_udf(rules)("_html", "url")))
    details = none
    if rules.labels:
        value = lambda k: F.col("_p.labels")[k]["value"]
        values = [T.first_non_empty(value(k), F.col("title")) if x == rules.titled else T.first_non_empty(value(k), F.col("date")) if x == rules.dated else value(k) for k, x in enumerate(rules.labels)]
        details = F.when(F.col("_p").isNotNull(), classify.all_or_none(list(rules.labels), values)).otherwise(none)
    own = F.array(F.struct(F.regexp_extract("url", "([^/]*)$", 1).alias("name"), F.col("url").alias("url")))
    out = out.withColumn("details", F.coalesce(details, none))
    out = out.withColumn("body", F.when(F.size("details") > 0, "").otherwise(F.coalesce(F.col("_p.body"), F.lit(""))))
    out = out.withColumn("date", T.first_non_empty(F.col("date"), P.posting_date(F.col("_p.dates"), rules.dates)))
    out = out.withColumn("files", F.when(F.col("_direct"), add_files(F.col("files"), own)).when(F.col("_p").isNotNull(), add_files(F.col("files"), F.col("_p.files"))).otherwise(F.col("files")))
    return out.withColumn("found", found(F.col("body"), F.col("details"), F.col("files"))).drop("_direct", "_url", "_html", "_p")
