"""op13: personal data in every document."""

from shelfgrid.llm.common import table
from shelfgrid.llm.personal_data import find_personal_data, train_tagger
from shelfgrid.llm.registry import query


@query("op13_personal_data")
def personal_data(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return find_personal_data(docs, train_tagger(docs))
