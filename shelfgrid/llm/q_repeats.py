"""op1: bytes of every document that lie in a repeated string of 200 bytes."""

from shelfgrid.llm.common import table
from shelfgrid.llm.registry import query
from shelfgrid.llm.suffix_dedup import remove_repeats


@query("op1_suffix_array_dedup")
def suffix_array_dedup(spark, directory):
    return remove_repeats(table(spark, directory, "documents").select("doc_id", "text"))
