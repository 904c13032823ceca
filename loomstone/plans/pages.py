"""Queries over saved web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.registry import query
from loomstone.sources.tables import table

SKELETON_TAGS = ("h1", "p", "a", "li", "ul", "nav", "article", "footer")


@query(
    "page_skeleton_tokens",
    """
    SELECT page_id, CAST(floor(length(html) / 4.0 + 0.5) AS BIGINT) AS raw_tokens,
           CAST(len(regexp_extract_all(html, '<(h1|p|a|li|ul|nav|article|footer)[ >]')) AS BIGINT) AS n_elements,
           CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS n_headings,
           CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS n_links
    FROM pages
    """,
)
def page_skeleton_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every raw page and the tags its skeleton keeps."""
    html = F.col("html")
    count = lambda pattern: F.size(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.floor(F.length(html) / 4.0 + 0.5).cast("long").alias("raw_tokens"),
        count(f"<({'|'.join(SKELETON_TAGS)})[ >]").alias("n_elements"),
        count("<h1[ >]").alias("n_headings"),
        count("<a[ >]").alias("n_links"),
    )
