"""Report index over html documents and name-prefix categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import rating


def plain(c: F.Column) -> F.Column:
    """Text without markup and with blanks collapsed."""
    text = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def report_index(reports: DataFrame, summary: int = 80) -> DataFrame:
    """path, category, title, date, rating, summary and place (newest first) of each report.

    reports: path, html. The title loses what follows its last ' | '; the date is looked for in the path, then in the text;
    the category is the path's first folder.
    """
    title = F.trim(F.regexp_replace(plain(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s*\|[^|]*$", ""))
    body = plain(F.regexp_extract("html", r"(?is)<p[^>]*>(.*?)</p>", 1))
    day = lambda c: F.regexp_extract(c, r"(20\d\d-\d\d-\d\d)", 1).try_cast("date")
    rows = reports.select("path", F.regexp_extract("path", r"^https?://[^/]+/([^/?#]+)", 1).alias("category"), title.alias("title"), F.coalesce(day(F.col("path")), day(F.col("html"))).alias("date"), rating(F.concat_ws(" ", title, body)).alias("rating"), F.substring(body, 1, summary).alias("summary"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("date"), "path", "title")))


def categorise(df: DataFrame, name: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """df with the category of the first of (prefix, category) that the name starts with, row by row."""
    first = [F.when(F.startswith(df[name], F.lit(prefix)), category) for prefix, category in prefixes]
    return df.withColumn("category", F.coalesce(*first) if first else F.lit(None).cast("string"))
