"""Argument checks and small helpers that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ArgumentError(ValueError):
    """An argument doesn't fit the table that it is for."""


def expr(x: str | Column) -> Column:
    """A column name or SQL expression."""
    return x if isinstance(x, Column) else F.expr(x)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def names(x: str | list[str] | None) -> list[str]:
    """A list of column names, from a list or a comma-separated text."""
    if x is None:
        return []
    return [n.strip() for n in x.split(",") if n.strip()] if isinstance(x, str) else list(x)


def column_exists(df: DataFrame, name: str) -> bool:
    return name in df.columns


def need_columns(df: DataFrame, *wanted: str) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ArgumentError(f"no such column: {', '.join(missing)}")


def options(text: str | dict | None, defaults: dict) -> dict:
    """`key=value, key=value` over defaults; values take the type of the default. Unknown keys raise."""
    out = dict(defaults)
    given = text.items() if isinstance(text, dict) else [p.split("=", 1) for p in (text or "").split(",") if p.strip()]
    for pair in given:
        if len(pair) != 2:
            raise ArgumentError(f"not a key=value pair: {pair[0]}")
        key, value = str(pair[0]).strip(), pair[1]
        if key not in defaults:
            raise ArgumentError(f"unknown option: {key}")
        kind = type(defaults[key])
        if isinstance(value, str):
            value = value.strip()
            value = value.lower() in ("true", "t", "yes", "1") if kind is bool else value if defaults[key] is None else kind(value)
        out[key] = value
    return out


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def no_null_groups(df: DataFrame, groups: list[str]) -> None:
    """Null grouping values raise."""
    if groups and not df.filter(" OR ".join(f"{quoted(g)} IS NULL" for g in groups)).isEmpty():
        raise ArgumentError("a grouping column has nulls")


def features(df: DataFrame, x: str | list[str] | Column) -> Column:
    """An array<double> column from an array column, an ARRAY[...] text, or a list of expressions."""
    if isinstance(x, list | tuple):
        return F.array(*[expr(c).cast("double") for c in x])
    if isinstance(x, str) and x.strip().lower().startswith("array[") and x.strip().endswith("]"):
        return F.expr(f"array({x.strip()[6:-1]})").cast("array<double>")
    return expr(x).cast("array<double>")


def complete(y: Column | None, x: Column) -> Column:
    """Whether a row takes part in a fit: no null in y, x or x's elements."""
    ok = x.isNotNull() & ~F.exists(x, lambda e: e.isNull())
    return ok if y is None else ok & y.isNotNull()


def relative_error(approx, value):
    """|a - e| / |e| of numbers, or by 2-norm of arrays."""
    from corvane.functions.metrics import dist_norm2, norm2

    def array(c):
        return isinstance(c, str) and c.lower().startswith("array")

    if array(approx) or array(value):
        return dist_norm2(expr(approx), expr(value)) / norm2(expr(value))
    return F.abs(expr(approx) - expr(value)) / F.abs(expr(value))


def vector_relative_error(approx, value):
    from corvane.functions.metrics import dist_norm2, norm2

    return dist_norm2(approx, value) / norm2(value)


def assert_(condition: bool, message: str) -> None:
    if not condition:
        raise AssertionError(message)


def raises_error(spark, sql: str) -> bool:
    """Whether a statement fails."""
    try:
        spark.sql(sql).collect()
    except Exception:
        return True
    return False


def bool_to_text(x) -> Column:
    return F.when(expr(x), F.lit("t")).when(~expr(x), F.lit("f"))


def mode(x) -> Column:
    """Aggregate: the most frequent value; of several the smallest."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {x})")


def cleanup_temp_tables(spark, prefix: str = "corvane_temp") -> list[str]:
    """Drops temporary views whose name contains the prefix."""
    found = [t.name for t in spark.catalog.listTables() if t.isTemporary and prefix in t.name]
    for name in found:
        spark.catalog.dropTempView(name)
    return found


def version() -> str:
    import pyspark

    from corvane import __version__

    return f"corvane {__version__}, Spark {pyspark.__version__}"
