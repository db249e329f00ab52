"""Rounding that follows the exact binary value of a double."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1: halves a double into two 26-bit parts


def exact_round(c: Column, digits: int) -> Column:
    """Nearest multiple of ``10**-digits`` to the stored value, true ties to even.

    ``bround`` rounds the shortest decimal text of the double; reports are written from the stored
    value, which may lie just beside such a tie. The product with the power of ten is therefore
    taken with its rounding error, and the error decides the apparent ties.
    """
    scale = F.lit(float(10**digits))
    value = c.cast("double")
    product = value * scale
    spread = value * F.lit(_SPLITTER)
    high = spread - (spread - value)
    error = (high * scale - product) + (value - high) * scale
    low = F.floor(product).cast("double")
    tie = (product - low) == 0.5
    nearest = F.when(tie & (error > 0), low + 1.0).when(tie & (error < 0), low).otherwise(F.rint(product))
    return nearest / scale


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits; NULL stays NULL."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", exact_round(c, digits)))
