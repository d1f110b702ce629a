"""Schema checks and column lists; everything here runs at plan time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descria.errors import MissingColumnError, NonNumericColumnError

CLASS_TARGET = "Label"
VALUE_TARGET = "value"
CLASS_PROTECTED = ("Label", "SMILES", "Name")
VALUE_PROTECTED = ("SMILES", "value", "Name")


def missing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Wanted names the table does not have, in the order they were asked for."""
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def remaining_columns(columns: Sequence[str], removed: Iterable[str]) -> list[str]:
    """``columns`` without ``removed``; the original order is kept."""
    gone = set(removed)
    return [c for c in columns if c not in gone]


def require_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every absent column."""
    absent = missing_columns(df, wanted)
    if absent:
        raise MissingColumnError(f"missing columns {absent}; available: {df.columns}")
    return df


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project to ``keep`` then ``features``; absent names are an error."""
    names = [*keep, *[f for f in features if f not in set(keep)]]
    return require_columns(df, names).select(*names)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_fractional(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.FractionalType) and not isinstance(field.dataType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in table order, without the excluded ones."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip]


def feature_columns(df: DataFrame, protected: Iterable[str] = ()) -> list[str]:
    """All columns that are not protected; a non-numeric one among them is an error."""
    skip = set(protected)
    fields = [f for f in df.schema.fields if f.name not in skip]
    bad = [f.name for f in fields if not is_numeric(f)]
    if bad:
        raise NonNumericColumnError(f"non-numeric feature columns: {bad}")
    return [f.name for f in fields]


def ident(name: str) -> str:
    """Column name as it must be written inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """Column reference that is safe for names holding dots or spaces."""
    return F.col(ident(name))


# Expressions over thousands of columns are written as SQL text: one call to the
# JVM each, where a chain of Column methods needs several per column.


def finite_sql(name: str) -> str:
    """The value as a double, NULL when missing, NaN or infinite (NaN sorts above infinity)."""
    return f"CASE WHEN abs(CAST({ident(name)} AS DOUBLE)) < CAST('Infinity' AS DOUBLE) THEN CAST({ident(name)} AS DOUBLE) END"


def gap_sql(field: T.StructField) -> str:
    """Whether the cell is NULL or NaN."""
    null = f"{ident(field.name)} IS NULL"
    return f"({null} OR isnan({ident(field.name)}))" if is_fractional(field) else f"({null})"


def array_sql(parts: Iterable[str]) -> str:
    return "array(" + ", ".join(parts) + ")"


def double_sql(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{float(value)!r}' AS DOUBLE)"


def replace_columns(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Replace columns in place by SQL expressions; every other column passes through."""
    require_columns(df, exprs)
    return df.selectExpr(*[f"{exprs[c]} AS {ident(c)}" if c in exprs else ident(c) for c in df.columns])


def name_at(position: Column, names: Sequence[str]) -> Column:
    """Feature name for a zero-based ordinal."""
    texts = ("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    return F.element_at(F.expr(array_sql(texts)), position + F.lit(1))
