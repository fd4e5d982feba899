"""Scalar column functions: guarded arithmetic, readable sizes and ages, safe output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the age and size ladders, largest integer JSON readers keep exact.
AGE_LADDER = [(90, 1, "s"), (5400, 60, " min"), (172800, 3600, " h")]
AGE_LAST = (86400, " days")
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
EXACT_JSON_INT = 2**53
TABLE_NAME = r"^[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def millis_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MILLISECOND", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def human_age(seconds: Column) -> Column:
    """Age in the largest fitting unit: seconds, minutes, hours, days."""
    def text(divisor: int, unit: str) -> Column:
        return F.concat(F.bround(seconds / float(divisor), 0).cast("bigint").cast("string"), F.lit(unit))

    ladder = reduce(lambda acc, step: acc.when(seconds < step[0], text(step[1], step[2])), AGE_LADDER, F)
    return ladder.otherwise(text(*AGE_LAST))


def human_bytes(n: Column) -> Column:
    """Size with one decimal in the largest unit below 1024."""
    value = n.cast("double")
    out = F
    for power, unit in enumerate(SIZE_UNITS):
        text = F.format_string(f"%.1f {unit}", F.bround(value / float(1024**power), 1))
        if unit == SIZE_UNITS[-1]:
            return out.otherwise(text)
        out = out.when(F.abs(value) < float(1024 ** (power + 1)), text)


def topic_parts(topic: Column) -> tuple[Column, Column]:
    """(namespace, table) of a topic named <prefix>.<namespace>.<table>."""
    parts = F.split(topic, r"\.", 3)
    return parts[1], parts[2]


def same_value(a: Column, b: Column, dtype_a: T.DataType, dtype_b: T.DataType) -> Column:
    """Null-safe equality; decimals compare by value whatever their scale."""
    if isinstance(dtype_a, T.DecimalType) and isinstance(dtype_b, T.DecimalType):
        scale = max(dtype_a.scale, dtype_b.scale)
        whole = max(dtype_a.precision - dtype_a.scale, dtype_b.precision - dtype_b.scale)
        wide = T.DecimalType(min(38, whole + scale), scale)
        return a.cast(wide).eqNullSafe(b.cast(wide))
    if dtype_a != dtype_b:
        return a.cast("string").eqNullSafe(b.cast("string"))
    return a.eqNullSafe(b)


def json_safe(df: DataFrame) -> DataFrame:
    """Values every JSON reader keeps exact.

    NaN and infinities become NULL, integers from 2^53 on and decimals become text, binary
    becomes hex, dates and timestamps become ISO text.
    """
    def safe(f: T.StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        match f.dataType:
            case T.DoubleType() | T.FloatType():
                finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
                return F.when(finite, c)
            case T.LongType():
                # one column has one type: the whole column turns to text
                return c.cast("string")
            case T.DecimalType():
                return c.cast("string")
            case T.BinaryType():
                return F.lower(F.hex(c))
            case T.DateType():
                return F.date_format(c, "yyyy-MM-dd")
            case T.TimestampType() | T.TimestampNTZType():
                return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return c

    return df.select(*[safe(f).alias(f.name) for f in df.schema])
