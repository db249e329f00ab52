"""op8: token counts of every document, from a cache that begins empty with each call."""

import public_tokenizers

from shelfgrid.llm.common import new_folder, table
from shelfgrid.llm.registry import query
from shelfgrid.llm.token_counts import count_tokens


@query("op8_token_counts")
def token_counts(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), new_folder(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
