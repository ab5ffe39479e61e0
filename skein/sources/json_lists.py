"""Lists that come as JSON: what to request for a page, and the rows of an answer.

Requests and answers are columns, so that a table of (source, page) becomes one
of requests, and one of answers becomes one of posts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonops as J
from ..functions import text as T

#: Members of a record that may hold its id, name, proposer, date and link, in order.  Fixed values.
ID = ("BILL_ID", "BILLID", "billId")
NAME = ("BILL_NAME", "BILL_NM", "billName")
PROPOSER = ("PROPOSER", "RST_PROPOSER", "proposer")
DATE = ("PROPOSE_DT", "PPSL_DT", "proposeDt")


def offset_form(page: Column, limit: int) -> Column:
    """The form of a list that is read by offset and length."""
    fields = {"draw": F.lit("1"), "start": ((F.greatest(page, F.lit(1)) - 1) * limit).cast("string"), "length": F.lit(str(limit))}
    fields |= dict.fromkeys(("searchKeyword", "searchCondition", "searchType"), F.lit(""))
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def index_query(key: str, page: Column, size: int, age: str = "") -> Column:
    """The parameters of a list that is read by page number; null without a key, as then there is no request."""
    fields = {"KEY": F.lit(key), "Type": F.lit("json"), "pIndex": F.greatest(page, F.lit(1)).cast("string"), "pSize": F.lit(str(size))}
    if age:
        fields["AGE"] = F.lit(age)
    made = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    return made if key else F.lit(None).cast("map<string,string>")


def _first_of_each(rows: DataFrame, keys: Sequence[str], limit: int | None) -> DataFrame:
    """Rows with an id and a title, the first of each id, at most ``limit`` a list."""
    kept = rows.where((F.col("id") != "") & (F.col("title") != ""))
    kept = kept.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "id").orderBy("pos"))).where("_k = 1")
    if limit is not None:
        kept = kept.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("pos"))).where(F.col("_k") <= limit)
    return kept.drop("_k")


def offset_rows(answers: DataFrame, keys: Sequence[str], body: str, limit: int, *, id_names: Sequence[str], title: str = "title", kind: str = "pastreqType", date: str = "replyRegDate") -> DataFrame:
    """(keys, pos, id, title, date) of answers to ``offset_form``; an answer without records has none."""
    rows = answers.select(*keys, F.posexplode(J.records(F.col(body))).alias("pos", "r"))
    kind_ = T.clean(F.replace(J.pick("r", [kind]), F.lit("(2014이전)"), F.lit("")))
    name = T.clean(J.pick("r", [title]))
    titled = F.when((kind_ != "") & (name != ""), F.concat(F.lit("["), kind_, F.lit("] "), name)).otherwise(name)
    rows = rows.select(*keys, "pos", J.pick("r", id_names).alias("id"), titled.alias("title"), T.clean(J.pick("r", [date])).alias("date"))
    return _first_of_each(rows, keys, limit)


def index_rows(answers: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """(keys, pos, id, title, date) of answers to ``index_query``.  A null answer
    (no request was made) and one without rows have none; an answer with an
    error code stops the query, as taking it for an empty list would end the scan."""
    code = J.result_code(F.col(body))
    checked = F.when(F.col(body).isNull() | J.result_ok(code), F.col(body)).otherwise(F.raise_error(F.concat(F.lit("the list answered with code "), code)))
    rows = answers.select(*keys, F.posexplode(J.envelope_rows(checked)).alias("pos", "r"))
    pick = lambda names: T.clean(T.first_non_empty(*(F.col("r")[n] for n in names)))
    rows = rows.select(*keys, "pos", pick(ID).alias("id"), T.titled(pick(NAME), pick(PROPOSER)).alias("title"), pick(DATE).alias("date"), (pick(NAME) != "").alias("_named"))
    return _first_of_each(rows.where("_named").drop("_named"), keys, None)
