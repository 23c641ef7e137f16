"""Order numbers.

The source system draws a random UUID per order. A random id changes when a
lost partition is recomputed, so replayable jobs derive a name-based id from
the request key instead: the md5 of ``order-<key>`` laid out as 8-4-4-4-12 hex.
``random_order_number`` keeps the random form for live, non-replayed use.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_number_for_key(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("order-"), key.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def random_order_number() -> Column:
    return F.expr("uuid()")
