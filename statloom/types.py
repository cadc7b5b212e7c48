"""The small type system of imported data: null, boolean, integer, real and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TO_SPARK: dict[str, T.DataType] = {"null": T.NullType(), "boolean": T.BooleanType(), "integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType()}


def type_name(kind: T.DataType) -> str:
    """The external name of a Spark type; nested, temporal and binary values count as text."""
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    return "text"


def widen(a: str, b: str) -> str:
    """The least type that holds both."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    pair = {a, b}
    if "text" in pair:
        return "text"
    return "real" if "real" in pair else "integer"


def column_type(kinds) -> str:
    """The type of a whole column; one with nulls only is text."""
    out = "null"
    for k in kinds:
        out = widen(out, k)
    return "text" if out == "null" else out


def normalise(df):
    """A frame with boolean, long, double and string columns only; FLOAT by its shortest decimal form."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        name = type_name(f.dataType)
        if isinstance(f.dataType, T.FloatType):
            c = c.cast("string").cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.coalesce(F.try_validate_utf8(c), F.when(c.isNotNull(), F.lit("[blob]")))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        else:
            c = c.cast(TO_SPARK["text" if name == "null" else name])
        out.append(c.alias(f.name))
    return df.select(*out)


def finite(c: Column | str) -> Column:
    """The value as a double, null if it is no finite number.  Text counts if it is a plain number."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def label(c: Column, kind: T.DataType) -> Column:
    """Text of a value as charts show it: whole reals without a fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")
