"""JSON objects out of loose model text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import strip_trailing_commas, trim

_SIGNS = re.compile(r'["\\{}\[\]]')


def balanced(body: str) -> str | None:
    """From the first brace to the brace that closes it; null if none does.

    Brackets of both kinds share one depth, and what stands in strings doesn't count.
    """
    start = body.find("{")
    depth, at, quoted = 0, start, False
    while at >= 0:
        m = _SIGNS.search(body, at)
        if not m:
            return None
        sign, at = m.group(), m.end()
        if sign == "\\":
            at += quoted
        elif sign == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if sign in "{[" else -1
            if depth == 0 and sign == "}":
                return body[start:at]
    return None


@F.pandas_udf(StringType())
def _balanced(bodies: pd.Series) -> pd.Series:
    return bodies.map(balanced, na_action="ignore")


def json_slice(text: Column) -> Column:
    """struct(slice, error): the object's text, from a code fence that has a brace if there is one."""
    body = trim(text)
    fenced = F.regexp_extract(body, r"```(?:json)?\s*([\s\S]*?)```", 1)
    body = F.when(F.contains(fenced, F.lit("{")), trim(fenced)).otherwise(body)
    found = _balanced(body)
    error = F.when(F.coalesce(F.instr(body, "{"), F.lit(0)) == 0, "no object").when(found.isNull(), "unbalanced")
    return F.struct(found.alias("slice"), error.alias("error"))


def extract_json(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `json` (VARIANT) and `error`; trailing commas go where the text doesn't parse as it is.

    Null and blank texts have no object.  Errors: no object, unbalanced, syntax.
    """
    out = df.withColumn("__s", json_slice(F.col(text)))
    raw = F.col("__s.slice")
    parsed = F.coalesce(F.try_parse_json(raw), F.try_parse_json(strip_trailing_commas(raw)))
    error = F.coalesce(F.col("__s.error"), F.when(parsed.isNull(), F.lit("syntax")))
    return out.withColumn("json", parsed).withColumn("error", error).drop("__s")


def response_content(df: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """df with `content` and `error` of a chat response: a string, or the joined texts of its parts."""
    v = F.try_parse_json(F.col(body))
    plain = F.try_variant_get(v, "$.choices[0].message.content", "string")
    parts = F.from_json(F.get_json_object(F.col(body), "$.choices[0].message.content"), "array<struct<text: string>>")
    is_list = F.get_json_object(F.col(body), "$.choices[0].message.content").startswith("[") & ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.choices[0].message.content", "variant")) == "STRING", F.lit(False))
    content = F.when(is_list, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(plain)
    good = F.col(status).between(200, 299)
    error = F.when(~good, F.concat(F.lit("HTTP "), F.col(status).cast("string"), F.lit(": "), F.substring(F.col(body), 1, 300))).when(content.isNull(), F.lit("no content"))
    return df.withColumn("content", F.when(good, content)).withColumn("error", error)


def joined_chunks(chunks: DataFrame, key: str = "plan_id", seq: str = "seq", text: str = "chunk", most: int = 1_000_000) -> DataFrame:
    """(key, text, error): chunks in order, as far as the one that takes the text over `most` characters.

    Null and empty chunks add nothing.  Lengths run over the chunks before any is collected, so that
    a key's text is bounded by `most` and its last chunk.
    """
    order = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = chunks.select(key, seq, F.col(text).alias("__t"), size.alias("__n"), F.coalesce(F.sum(size).over(order), F.lit(0)).alias("__before"))
    part = F.when((F.col("__before") <= most) & (F.col("__n") > 0), F.struct(F.col(seq), F.col("__t")))
    out = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda c: c["__t"]), "").alias("text"))
    return out.withColumn("error", F.when(trim(F.col("text")) == "", F.lit("empty response")))
