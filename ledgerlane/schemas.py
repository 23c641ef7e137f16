"""Record types of the order-event domain as Spark schemas.

Decimals: the source system uses arbitrary-precision decimals. Spark has no
arbitrary-scale type, so event values are DECIMAL(38,6) and prices
DECIMAL(26,6); inputs that these can't hold exactly are not rounded but listed (decision R1).
Fixture adapters produce DECIMAL(18,2), which widens into these losslessly.
"""

from pyspark.sql.types import (ArrayType, DecimalType, IntegerType, LongType, StringType,
                               StructField, StructType)

EVENT_VALUE = DecimalType(38, 6)
PRICE = DecimalType(26, 6)

# The order statuses the source system produces.
CONFIRMED = "CONFIRMED"
FAILED = "FAILED"

# JSON wire form of an order event (camelCase names, in declaration order).
ORDER_EVENT_WIRE = StructType([
    StructField("orderNumber", StringType()),
    StructField("orderEmail", StringType()),
    StructField("orderStatus", StringType()),
    StructField("totalOrderValue", EVENT_VALUE),
])
WIRE_FIELDS = [f.name for f in ORDER_EVENT_WIRE.fields]

# Columnar form used by every operator.
ORDER_EVENT = StructType([
    StructField("order_number", StringType()),
    StructField("order_email", StringType()),
    StructField("order_status", StringType()),
    StructField("total_order_value", EVENT_VALUE),
])

REQUEST_LINE = StructType([
    StructField("id", LongType()),
    StructField("sku_code", StringType()),
    StructField("price", PRICE),
    StructField("quantity", IntegerType()),
])

# Columnar form of a request; the key is derived from the record (see sources.requests).
ORDER_REQUEST = StructType([
    StructField("order_key", LongType()),
    StructField("order_email", StringType()),
    StructField("items", ArrayType(REQUEST_LINE)),
])

# JSON wire form of a request (camelCase names).
ORDER_REQUEST_WIRE = StructType([
    StructField("orderEmail", StringType()),
    StructField("orderLineItemsDtoList", ArrayType(StructType([
        StructField("id", LongType()),
        StructField("skuCode", StringType()),
        StructField("price", StringType()),   # the number as written
        StructField("quantity", IntegerType()),
    ]))),
])

INVENTORY = StructType([
    StructField("sku_code", StringType()),
    StructField("quantity", IntegerType()),
])
