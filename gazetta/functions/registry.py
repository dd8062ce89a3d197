"""Functions for SQL users. The scalar ones are SQL expressions, so they stay inside code generation."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gazetta.functions.quantity import FIRST, SCALES


class MarkdownLinks:
    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        for title, url in re.findall(r"\[([^\]]*)\]\((https?://[^)\s]+)\)", text or ""):
            yield title, url


def register(spark: SparkSession) -> None:
    """normalize_bias(text), parse_quantity(text), cosine(a, b), and the table function markdown_links(text)."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION normalize_bias(b STRING) RETURNS STRING RETURN
        CASE WHEN contains(lower(b), 'left') THEN 'left' WHEN contains(lower(b), 'right') THEN 'right' WHEN contains(lower(b), 'cent') OR contains(lower(b), 'middle') THEN 'center' END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        CASE WHEN size(a) = size(b) AND dot(a, a) > 0 AND dot(b, b) > 0 THEN dot(a, b) / (sqrt(dot(a, a)) * sqrt(dot(b, b))) ELSE 0D END""")
    scales = ", ".join(f"'{word}', {factor!r}D" for word, factor in SCALES.items())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION parse_quantity(t STRING) RETURNS DOUBLE RETURN
        try_cast(replace(regexp_extract(lower(t), r'{FIRST}', 1), ',', '') AS DOUBLE) * coalesce(map({scales})[regexp_extract(lower(t), r'{FIRST}', 2)], 1D)""")
    spark.udtf.register("markdown_links", udtf(MarkdownLinks, returnType="title string, url string"))
