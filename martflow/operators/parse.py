"""JSON text to columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, StringType, StructField, StructType


def once(column: Column) -> Column:
    """Evaluate a costly column once per row.

    Without the one-element explode Catalyst copies the expression into each use
    of its result, and JSON text would be parsed for every field.
    """
    return F.explode(F.array(column))


def parse(messages: DataFrame, schema: str, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse JSON text and coerce each number to its field's type.

    Numbers may come as text or with a fraction; one that fits no number is null
    and its row stays.  Text that is not a JSON object is left out (see
    ``malformed``).
    """
    rows = messages.select(*keep, once(F.from_json(value, _marked(schema), _OPTIONS)).alias("v")).filter(_readable())
    fields = StructType.fromDDL(schema)
    return rows.select(*keep, *[_coerced(F.col("v")[f.name], f.dataType).alias(f.name) for f in fields])


def parse_all(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Like ``parse``, in one pass with the quarantine: ``row`` is the parsed record,
    and ``bad`` the text of a message that is none; the other one is null."""
    rows = messages.select(value, once(F.from_json(value, _marked(schema), _OPTIONS)).alias("v"))
    fields = [_coerced(F.col("v")[f.name], f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return rows.select(F.when(_readable(), F.struct(*fields)).alias("row"),
                       F.when(_readable(), F.lit(None)).otherwise(F.coalesce(value, F.lit(""))).alias("bad"))


def parse_record(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Parse flat JSON records and coerce each field to its column's type.

    Change feeds carry numbers as text or as numbers; both are taken, and what
    does not fit the type is null.
    """
    fields = StructType.fromDDL(schema)
    rows = messages.select(once(F.from_json(value, "map<string,string>")).alias("v")).filter(F.size("v") > 0)
    return rows.selectExpr(*[f"try_cast(v['{f.name}'] AS {f.dataType.simpleString()}) AS {f.name}" for f in fields])


def malformed(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The quarantine: messages that ``parse`` leaves out, untouched."""
    rows = messages.select("*", once(F.from_json(value, _marked(schema), _OPTIONS)).alias("v"))
    return rows.filter(~_readable()).drop("v")


def serialise(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _marked(schema: str) -> StructType:
    return _loose(StructType.fromDDL(schema)).add("_corrupt_record", StringType())


def _loose(kind: DataType) -> DataType:
    """The type with text in place of whole numbers, which a JSON reader takes in any form."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _loose(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(_loose(kind.elementType))
    return StringType() if isinstance(kind, IntegralType) else kind


def _coerced(column: Column, kind: DataType) -> Column:
    if _loose(kind) == kind:
        return column
    if isinstance(kind, StructType):
        fields = F.struct(*[_coerced(column[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _coerced(x, kind.elementType))
    return F.coalesce(column.try_cast(kind), column.try_cast("double").try_cast(kind))


def _readable():
    return F.col("v").isNotNull() & F.col("v._corrupt_record").isNull()


def is_blank(c: str):
    """Null or empty text."""
    return F.coalesce(F.col(c), F.lit("")) == ""


def is_entry_page(column: str = "page.last_page_id"):
    """A page nobody navigated from opens a visit."""
    return is_blank(column)
