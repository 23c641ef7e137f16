"""JSON codec for order events as column expressions.

All four run inside whole-stage code generation; nothing leaves the JVM.

Decode strictness (D1) follows a default-configured JSON object mapper:

* malformed, truncated, wrong-shape (``[1]``), ``null`` or empty input,
  single-quoted strings, ``NaN``/``Infinity``, leading zeros, trailing commas → dropped
* any field name outside the four known ones (also a wrong-case name) → dropped
* a value that is not a number (``"abc"``, ``true``) → dropped
* an object or array where text is expected → dropped
* missing fields, ``{}``, quoted numbers (blanks around them trimmed, an empty one
  is null), numbers or booleans in text fields, trailing text after the object,
  repeated fields (last wins) → kept
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from ledgerlane.schemas import EVENT_VALUE, WIRE_FIELDS

_CORRUPT = "_corrupt_record"
# A number as the mapper reads it from a number or from quoted text.
_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_BLANKS = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"
_BARE_VALUE = r'"totalOrderValue"\s*:\s*(-?[0-9][-+0-9.eE]*)'
# Every field as text, so that an object or array where text is expected (which the mapper
# rejects) can be told.
_DECODE_SCHEMA = StructType([StructField(n, StringType()) for n in [*WIRE_FIELDS, _CORRUPT]])
# Standard JSON only, as a default object mapper reads it: Spark's parser
# would otherwise accept single-quoted strings.
_PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
                  "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
                  "allowNumericLeadingZeros": "false", "allowComments": "false"}
_VALUE_TYPE = EVENT_VALUE.simpleString()
UNREPRESENTABLE = "value beyond " + _VALUE_TYPE


def _known_keys() -> Column:
    return F.array(*[F.lit(n) for n in WIRE_FIELDS])


def _nested(text: Column) -> Column:
    """Whether a text field holds an object or array: its parsed form starts like one, and the
    record has one behind the field's name (a quoted text may start with a brace too)."""
    one = lambda n: (F.coalesce(F.col(f"_e.{n}").rlike(r"^[\[{]"), F.lit(False))
                     & text.rlike(rf'"{n}"\s*:\s*[\[{{]'))
    return one(WIRE_FIELDS[0]) | one(WIRE_FIELDS[1]) | one(WIRE_FIELDS[2])


def _parsed(raw: DataFrame, value_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(keep…, _e, _keys, _nested, _token): the token is the value as written, blanks around it gone,
    null for an empty text."""
    text = F.col(value_col).cast("string")
    parsed = raw.select(*[F.col(c) for c in keep], text.alias("_text"),
                        F.from_json(text, _DECODE_SCHEMA, _PARSE_OPTIONS).alias("_e"),
                        F.json_object_keys(text).alias("_keys"))
    # A bare number comes back by way of a double; its token is the last one in the record
    # that names the field and equals it. Quoted text comes back as it is.
    value = F.col("_e.totalOrderValue")
    bare = F.filter(F.regexp_extract_all("_text", F.lit(_BARE_VALUE), F.lit(1)),
                    lambda t: t.try_cast("double") == value.try_cast("double"))
    token = F.coalesce(F.get(bare, F.size(bare) - 1),
                       without_blanks(value))
    return parsed.select(*[F.col(c) for c in keep], "_e", "_keys",
                         _nested(F.col("_text")).alias("_nested"), token.alias("_token"))


def _readable() -> Column:
    return (F.col("_e").isNotNull() & F.col(f"_e.{_CORRUPT}").isNull() & F.col("_keys").isNotNull()
            & (F.size(F.array_except(F.col("_keys"), _known_keys())) == 0) & ~F.col("_nested")
            & F.coalesce(F.col("_token").rlike(_NUMBER), F.lit(True)))


def is_number(token: Column) -> Column:
    """Whether the mapper reads the token, from a number or from quoted text, as a number."""
    return token.rlike(_NUMBER)


def without_blanks(token: Column) -> Column:
    """Quoted text as the mapper takes it for a number: blanks around it gone, null if nothing is left."""
    return F.nullif(F.regexp_replace(token, _BLANKS, ""), F.lit(""))


def fits_exactly(token: Column, kind: DecimalType) -> Column:
    """Whether the token's number fits the decimal type without rounding: its decimals, less what the
    exponent takes away, number no more than the scale. A zero always does."""
    fraction = F.length(F.regexp_extract(token, r"[.]([0-9]*?)0*([eE]|$)", 1))
    whole_zeros = F.when(fraction > 0, F.lit(0)).otherwise(
        F.length(F.regexp_extract(token, r"^[+-]?[0-9]*?(0*)([.]0*)?([eE]|$)", 1)))
    exponent = F.coalesce(F.regexp_extract(token, r"[eE]([+-]?[0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    zero = token.rlike(r"^[+-]?[0.]+([eE]|$)")
    return token.try_cast(kind).isNotNull() & (zero | (fraction - whole_zeros - exponent <= kind.scale))


def _exact() -> Column:
    """Whether the token's number fits the value type without rounding."""
    token = F.col("_token")
    return F.when(token.isNull(), F.lit(True)).otherwise(fits_exactly(token, EVENT_VALUE))


def decode_order_events(raw: DataFrame, value_col: str = "value",
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse ``value`` (JSON text or bytes) into order-event columns; bad records
    are dropped. ``value_text`` keeps the number token of the value as
    received (``41000``, ``12.30``) for text renderings; a decimal column
    would print its full scale instead. Numbers that the value type can't hold
    exactly are not rounded: ``unrepresentable_events`` lists them."""
    row = F.struct(
        *[F.col(c) for c in keep],
        F.col("_e.orderNumber").alias("order_number"),
        F.col("_e.orderEmail").alias("order_email"),
        F.col("_e.orderStatus").alias("order_status"),
        F.col("_token").try_cast(_VALUE_TYPE).alias("total_order_value"),
        F.col("_token").alias("value_text"))
    # A flatMap (zero or one row per record) rather than filter + project: a
    # filter would be pushed below the parse and repeat it per condition.
    return _parsed(raw, value_col, keep).select(F.inline(F.when(_readable() & _exact(), F.array(row))))


def unrepresentable_events(raw: DataFrame, value_col: str = "value",
                           keep: tuple[str, ...] = ()) -> DataFrame:
    """Records that decode but for their number, which has more than 38 digits or six decimals."""
    row = F.struct(*[F.col(c) for c in keep], F.col("_e.orderNumber").alias("order_number"),
                   F.col("_token").alias("value_text"), F.lit(UNREPRESENTABLE).alias("reason"))
    return _parsed(raw, value_col, keep).select(F.inline(F.when(_readable() & ~_exact(), F.array(row))))


def plain_number(value: Column) -> Column:
    """Exact text of a decimal without the zeros that its type adds: 10.005000 → 10.005, 5.00 → 5."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def order_event_json(value_scale: int | None = None) -> Column:
    """JSON object of an order event in declaration order, nulls written out (D2 value). The
    value is written exactly; only a caller who names ``value_scale`` gets it rounded to
    that many decimals."""
    value = F.col("total_order_value")
    number = plain_number(value) if value_scale is None else value.cast(
        f"decimal(38,{value_scale})").cast("string")
    head = F.to_json(F.struct(F.col("order_number").alias("orderNumber"),
                              F.col("order_email").alias("orderEmail"),
                              F.col("order_status").alias("orderStatus")),
                     {"ignoreNullFields": "false"})
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"totalOrderValue":'),
                    F.coalesce(number, F.lit("null")), F.lit("}"))


def encode_order_events(events: DataFrame, value_scale: int | None = None) -> DataFrame:
    """Keyed records ``(key BINARY, value STRING)``; a record without an
    order number cannot be keyed and is not produced."""
    return (events.filter(F.col("order_number").isNotNull())
                  .select(F.col("order_number").cast("binary").alias("key"),
                          order_event_json(value_scale).alias("value")))


def json_quote(text: Column) -> Column:
    """A string as a JSON string literal (quotes and escapes), e.g.
    ``abc`` → ``"abc"``. Spark has no bare-string ``to_json``; wrap the string
    in a one-field struct and cut the field out of ``{"v":...}``."""
    j = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    # {"v":<literal>} → <literal>: 1-based start 6, length len - 6
    return F.substr(j, F.lit(6), F.length(j) - F.lit(6))


def generator_json() -> Column:
    """D3: the synthetic generator's hand-built JSON, field order orderNumber,
    orderEmail, totalOrderValue, orderStatus, the number unquoted."""
    return F.concat(
        F.lit('{"orderNumber":"'), F.col("order_number"),
        F.lit('","orderEmail":"'), F.col("order_email"),
        F.lit('","totalOrderValue":'), F.col("total_order_value").cast("string"),
        F.lit(',"orderStatus":"'), F.col("order_status"), F.lit('"}'))
