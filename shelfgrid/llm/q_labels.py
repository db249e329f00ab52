"""op5 and op7: toxicity and quality of every document, learned from the labelled rows that are not held out."""

from pyspark.sql import functions as F

from shelfgrid.llm.common import table
from shelfgrid.llm.quality import score_quality
from shelfgrid.llm.registry import query
from shelfgrid.llm.toxicity import score_toxicity


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


#: Classifiers learn from about so many labelled rows, those of smallest hash.
TRAINING_ROWS = 50_000


def training_rows(docs, labels, folds: int, held: int, label: str, most: int = TRAINING_ROWS):
    """(doc_id, text, label) of about ``most`` labelled rows that are not held out, or of all if there are fewer.

    As their number is bounded, the labels are broadcast to the texts, and no text is shuffled.
    """
    labels = labels.where((remainder(folds) != held) & F.col(label).isin(0, 1)).select("doc_id", label).distinct()
    share = int(1_000_000 * min(1.0, most / max(labels.count(), 1)))
    kept = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").select("doc_id", "text", label)


@query("op5_toxicity")
def toxicity(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text")
    labelled = training_rows(docs, table(spark, directory, "labels"), 3, 1, "toxic")
    scored = score_toxicity(docs, labelled)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query("op7_quality_classifier")
def quality(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text")
    labelled = training_rows(docs, table(spark, directory, "labels"), 4, 2, "quality")
    scored = score_quality(docs, labelled)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")
