"""Landed service payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Result codes of a good answer.
GOOD_XML_CODES = ["00", "000"]
GOOD_JSON_CODES = ["00", "000", "0"]


def _accepted(df: DataFrame, code: Column, message: Column, good_codes: list[str], strict: bool) -> DataFrame:
    """Good answers; another result code aborts the job, or drops the answer when not strict. A missing code is good."""
    known = F.trim(F.coalesce(code, F.lit("")))
    good = (known == "") | known.isin(good_codes)
    if not strict:
        return df.where(good)
    told = F.concat(F.lit("service answered "), known, F.lit(" "), F.coalesce(message, F.lit("")))
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def parse_xml(payloads: DataFrame, item_schema: str, column: str = "payload", strict: bool = True) -> DataFrame:
    """Items of XML answers: one row per item with the declared total; an answer without items gives no row.

    ``item_schema`` lists the item fields as DDL, read as text by the service. A result code
    other than success aborts the job unless ``strict`` is off, which drops such answers.
    """
    schema = (
        "header struct<resultCode:string,resultMsg:string>, "
        f"body struct<items:struct<item:array<struct<{item_schema}>>>,totalCount:string>"
    )
    keep = [F.col(c) for c in payloads.columns if c != column]
    parsed = payloads.select(*keep, F.from_xml(F.col(column), schema).alias("_x"))
    parsed = _accepted(parsed, F.col("_x.header.resultCode"), F.col("_x.header.resultMsg"), GOOD_XML_CODES, strict)
    total = F.col("_x.body.totalCount").try_cast("int").alias("total_count")
    return parsed.select(*keep, total, F.explode("_x.body.items.item").alias("_i")).select(
        *[c for c in payloads.columns if c != column], "total_count", "_i.*"
    )


def parse_json(payloads: DataFrame, item_schema: str, column: str = "payload", strict: bool = True) -> DataFrame:
    """Items of JSON answers, however they are wrapped; an answer without items gives no row.

    Accepts ``items`` as a list, as ``{"item": [..]}``, as one object, or ``item`` in the body.
    The first wrapping that parses to items wins. Result codes count as in ``parse_xml``; an answer
    that does not declare its total has the number of its items.
    """
    code = F.coalesce(*[F.get_json_object(column, f"$.{p}header.resultCode") for p in ("response.", "")])
    message = F.coalesce(*[F.get_json_object(column, f"$.{p}header.resultMsg") for p in ("response.", "")])
    payloads = _accepted(payloads, code, message, GOOD_JSON_CODES, strict)
    body = F.coalesce(F.get_json_object(column, "$.response.body"), F.get_json_object(column, "$.body"), F.col(column))
    bodied = payloads.withColumn("_b", body)
    fields = [f.strip().split()[0].split(":")[0] for f in item_schema.split(",")]
    candidates = [F.get_json_object("_b", p) for p in ("$.items.item", "$.items", "$.item")]

    def items(text):
        many = F.from_json(F.when(text.startswith("["), text), f"array<struct<{item_schema}>>")
        one = F.from_json(F.when(text.startswith("{"), text), f"struct<{item_schema}>")
        known = one.isNotNull() & F.coalesce(*[one[f].cast("string") for f in fields]).isNotNull()
        return F.coalesce(many, F.when(known, F.array(one)))

    listed = bodied.withColumn("_items", F.coalesce(*[items(c) for c in candidates]))
    total = F.coalesce(F.get_json_object("_b", "$.totalCount").try_cast("int"), F.size("_items")).alias("total_count")
    rows = listed.select(*payloads.columns, total, F.explode("_items").alias("_i"))
    return rows.drop(column).select(*[c for c in payloads.columns if c != column], "total_count", "_i.*")
