"""Response envelopes: landed JSON of several shapes to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(pages: DataFrame, body: str, fields: Sequence[str]) -> DataFrame:
    """The rows of each page as columns ``fields`` (text), with the page's other columns; ``quarantined`` pages aside.

    Known shapes: [], [[..], ..], [[[..], ..]], {Result: {Rows}}, [{Result: {Rows}}] with rows or one object, [{..}, ..].
    Positional rows take their names by order: values too many are dropped, missing ones are null."""
    doc = F.try_parse_json(F.col(body))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    kept = [c for c in pages.columns if c != body]
    rows = pages.select(*kept, doc.alias("__doc"))
    d = F.col("__doc")
    inner = F.coalesce(get(d, "$.Result.Rows", "array<variant>"), get(d, "$[0].Result.Rows", "array<variant>"), F.when(get(d, "$[0].Result.Rows", "variant").isNotNull(), F.array(get(d, "$[0].Result.Rows", "variant"))))
    # [[[..], ..]]: one element that holds the rows
    wrapped = F.when(F.size(get(d, "$", "array<variant>")) == 1, F.when(get(d, "$[0][0][0]", "variant").isNotNull() | get(d, "$[0][0]", "map<string,variant>").isNotNull(), get(d, "$[0]", "array<variant>")))
    found = F.coalesce(inner, wrapped, get(d, "$", "array<variant>"))
    each = rows.select(*kept, F.explode(found).alias("__row"))
    value = lambda i, name: F.coalesce(get(F.col("__row"), f"$['{name}']", "string"), get(F.col("__row"), f"$[{i}]", "string"))
    return each.select(*kept, *(value(i, f).alias(f) for i, f in enumerate(fields)))


def quarantined(pages: DataFrame, body: str) -> DataFrame:
    """Pages that are no JSON, or JSON of another shape."""
    d = F.try_parse_json(F.col(body))
    known = F.try_variant_get(d, "$", "array<variant>").isNotNull() | F.try_variant_get(d, "$.Result.Rows", "array<variant>").isNotNull()
    return pages.where(~F.coalesce(known, F.lit(False)))


def errors(body: Column) -> Column:
    """(message, kind) of an error response: messages joined by a space, and whether the session or the call failed."""
    found = F.from_json(body, "Result struct<ResponseStatus: struct<Errors: array<struct<Message: string>>>>")
    message = F.array_join(F.transform(found["Result"]["ResponseStatus"]["Errors"], lambda e: e["Message"]), " ")
    kind = F.when(F.coalesce(message, F.lit("")) == "", None).when(message.rlike("(?i)session|会话|登录"), "session").otherwise("api")
    return F.struct(message.alias("message"), kind.alias("kind"))


def positional(values: Column, names: Sequence[str]) -> list[Column]:
    return [F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)]
