"""op4: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import html_text
from rillway.llm.common import table


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op4_html": op4_html}
#: Parsing markup is beyond SQL; tests compare with texts whose markup is known.
ORACLE_SQL: dict[str, str] = {}
