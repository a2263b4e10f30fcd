"""Query: main text of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.llm import html_region, shared
from daygrid.llm.catalog import query


@query("op11_html_region")
def main_texts(spark, sf_dir):
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_region.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
