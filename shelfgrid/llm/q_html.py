"""op6: the main text of every page."""

from shelfgrid.llm.common import table
from shelfgrid.llm.html_text import extract_text
from shelfgrid.llm.registry import query


@query("op6_html_extraction")
def html_extraction(spark, directory):
    return extract_text(table(spark, directory, "pages").select("page_id", "url", "html"))
