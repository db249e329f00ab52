"""op4: the 20 nearest vectors, by inner product, of every vector whose id is divisible by 20."""

from pyspark.sql import functions as F

from shelfgrid.llm.common import table
from shelfgrid.llm.nearest import nearest
from shelfgrid.llm.registry import query


@query("op4_nearest_neighbours")
def nearest_neighbours(spark, directory):
    return nearest(table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0)
