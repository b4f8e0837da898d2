"""Column-level helpers shared by every operator (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing marker used when comparing a feature with the target,
# and the seed of every random draw.
MISSING_TOKEN = "__missing__"
SEED = 42

# The portable hash keeps 28 bits, so that Spark and other engines agree row for row.
HASH_BITS = 28
HASH_SPACE = 1 << HASH_BITS


def _field(df: DataFrame, name: str) -> T.StructField:
    return df.schema[name]


def is_numeric_type(dt: T.DataType, *, with_bool: bool = False) -> bool:
    if isinstance(dt, T.BooleanType):
        return with_bool
    return isinstance(dt, T.NumericType)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_categorical_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def kind_of(dt: T.DataType) -> str:
    """numeric / categorical / datetime / other, as the profile splits columns."""
    if is_numeric_type(dt):
        return "numeric"
    if is_categorical_type(dt):
        return "categorical"
    if is_datetime_type(dt):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame, *, with_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, with_bool=with_bool)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical_type(f.dataType)]


def miss(df: DataFrame, name: str) -> Column:
    """True where the value is missing: NULL, or NaN for floating columns."""
    c = F.col(f"`{name}`")
    if isinstance(_field(df, name).dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clean(df: DataFrame, name: str) -> Column:
    """The value with NaN mapped to NULL (one NaN turns avg/max into NaN)."""
    c = F.col(f"`{name}`")
    if isinstance(_field(df, name).dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def key_string(key_cols: Sequence[str]) -> Column:
    """Keys joined as text ('1|7'); integer and string keys print alike everywhere."""
    return F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key_cols])


# Fixed values of the integer-key hash: a Mersenne prime modulus and three multipliers.
# Every intermediate stays below 2^63, so Spark (ANSI) and other SQL engines agree exactly.
_MOD = 2147483647
_MUL = (48271, 69621, 40692)


def _int_mix(cols: Sequence[Column], seed: int) -> Column:
    h = F.lit(seed % _MOD).cast("bigint")
    m = F.lit(_MOD)
    for c in cols:
        x = F.pmod(c.cast("bigint"), m)
        h = F.pmod(h * _MUL[0] + x, m)
        h = F.pmod(h * h + _MUL[1], m)
        h = F.pmod(h * _MUL[2] + x, m)
    return F.pmod(h, F.lit(HASH_SPACE))


def phash(key_cols: Sequence[str], seed: int = SEED, df: DataFrame | None = None) -> Column:
    """Portable 28-bit hash of the key.

    Integer keys (``df`` given, all key columns integral): modular multiply/square rounds,
    a few arithmetic operations per row inside whole-stage codegen.  Other keys: the first
    7 hex digits of md5(key || ':' || seed).
    """
    if df is not None and all(isinstance(df.schema[k].dataType, T.IntegralType) for k in key_cols):
        return _int_mix([F.col(f"`{k}`") for k in key_cols], seed)
    digest = F.md5(F.concat(key_string(key_cols), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def phash_sql(key_sql: Sequence[str], seed: int = SEED, integer: bool = True) -> str:
    """The same hash in DuckDB SQL (used by the oracle strings)."""
    if integer:
        h = f"CAST({seed % _MOD} AS BIGINT)"
        for k in key_sql:
            x = f"((CAST({k} AS BIGINT) % {_MOD} + {_MOD}) % {_MOD})"
            h = f"(({h}) * {_MUL[0]} + {x}) % {_MOD}"
            h = f"(({h}) * ({h}) + {_MUL[1]}) % {_MOD}"
            h = f"(({h}) * {_MUL[2]} + {x}) % {_MOD}"
        return f"(({h}) % {HASH_SPACE})"
    key = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in key_sql) + ")"
    return f"CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 7)) AS BIGINT)"


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; NULL where a side is constant (never raises under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    xm, ym = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))


def r6(c: Column) -> Column:
    """Round a metric to 6 places (both sides of an oracle comparison do the same)."""
    return F.round(c.cast("double"), 6)


def unpivot(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], *,
            name_col: str = "column_name", value_col: str = "value", value_type: str = "double") -> DataFrame:
    """Wide to long by one narrow Generate (no shuffle)."""
    if not value_cols:
        raise ValueError("unpivot needs at least one value column")
    ids = [F.col(f"`{c}`") for c in id_cols]
    return long_rows(df, ids, [name_col, value_col], [(c, F.col(f"`{c}`").cast(value_type)) for c in value_cols])


def long_rows(df: DataFrame, keep: Sequence[Column], names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """One output row per entry of ``rows`` for each input row; entries are columns or plain values.

    Values travel as literals, so any column name can be among them.
    """
    def cell(v):
        return v if isinstance(v, Column) else F.lit(v)
    structs = [F.struct(*[cell(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return df.select(*keep, F.inline(F.array(*structs)))


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()
