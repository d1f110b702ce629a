"""Per-column statistics from one narrow pass over packed rows.

Wide tables are exploded to ``(pos, v)`` cells inside the map stage and reduced
by a partial aggregate keyed by the column ordinal, so the shuffle carries one
row per column and task whatever the number of rows is. Measured on 64 columns
this is more than twice as fast as one wide aggregate, and unlike it the plan
does not grow with the number of statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descria.columns import array_sql, double_sql, finite_sql, gap_sql, ident, is_numeric, name_at
from descria.functions.numeric import is_infinite

# Half-widths of the rank brackets asked from the quantile sketch, tried in turn, and the
# sketch's accuracy (rank error 1/accuracy). Every bracket is verified by exact counting.
_BRACKETS = (2e-4, 1e-2)
_ACCURACY = 10_000
_BELOW = float("-inf")


def cells(df: DataFrame, columns: Sequence[str], *extra: Column, raw: bool = False) -> DataFrame:
    """Long form ``(*extra, pos, v)`` of the given columns as doubles.

    ``raw=False`` turns NaN and infinities into NULL first.
    """
    value = (lambda c: f"CAST({ident(c)} AS DOUBLE)") if raw else finite_sql
    packed = F.expr(array_sql(value(c) for c in columns))
    rows, names = _beside(df, columns, extra)
    kept = [F.col(f"__x{k}").alias(n) for k, n in enumerate(names)]
    return rows.select(*kept, F.posexplode(packed).alias("pos", "v"))


def _beside(df: DataFrame, columns: Sequence[str], extra: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """The columns plus ``extra`` as ``__x0, __x1, ...`` in a projection of their own, and the names of ``extra``.

    In one projection with the explode, ``extra`` would be evaluated again for every
    cell. The array itself stays inside the explode: as a column, Spark would infer a
    filter on its size and copy the whole expression down the plan.
    """
    if not extra:
        return df, []
    own = {f"__x{k}": c for k, c in enumerate(extra)}
    return df.withColumns(own).selectExpr(*[ident(c) for c in columns], *own), df.select(*extra).columns


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts of every kind of cell and moments of the finite ones.

    ``variance`` is the population variance; all moments ignore missing cells.
    """
    finite = F.when(~is_infinite(F.col("v")) & ~F.isnan("v"), F.col("v"))
    missing = F.col("v").isNull() | F.isnan("v")
    stats = (
        cells(df, columns, raw=True)
        .groupBy("pos")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(missing).alias("n_missing"),
            F.count_if(F.coalesce(is_infinite(F.col("v")), F.lit(False))).alias("n_inf"),
            F.count(finite).alias("n_valid"),
            F.avg(finite).alias("mean"),
            F.var_pop(finite).alias("variance"),
            F.min(finite).alias("min"),
            F.max(finite).alias("max"),
        )
    )
    return stats.select("pos", name_at(F.col("pos"), columns).alias("feature"), *stats.columns[1:])


def missing_counts(df: DataFrame, columns: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Missing cells per column for columns of any type, and the mean of numeric ones.

    With ``keep`` (a boolean row expression) the table need not be filtered first:
    ``n_rows_in`` counts all rows; ``n_rows``, ``n_missing`` and ``mean`` only kept ones.
    """
    kept = F.lit(True) if keep is None else keep
    fields = {f.name: f for f in df.schema.fields}

    def cell(c: str) -> str:
        number = finite_sql(c) if is_numeric(fields[c]) else "CAST(NULL AS DOUBLE)"
        return f"struct({gap_sql(fields[c])} AS gap, {number} AS v)"

    packed = F.expr(array_sql(cell(c) for c in columns))
    rows, _ = _beside(df, columns, [kept])
    long = rows.select(F.col("__x0").alias("kept"), F.posexplode(packed).alias("pos", "x"))
    stats = long.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_rows_in"),
        F.count_if("kept").alias("n_rows"),
        F.count_if(F.col("kept") & F.col("x.gap")).alias("n_missing"),
        F.avg(F.when(F.col("kept"), F.col("x.v"))).alias("mean"),
    )
    return stats.select("pos", name_at(F.col("pos"), columns).alias("feature"), *stats.columns[1:])


def col_nan_fraction(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, nan_fraction)`` over the given columns (default: all)."""
    counts = missing_counts(df, list(columns or df.columns))
    return counts.select(
        "feature", F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")).alias("nan_fraction")
    )


def total_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of missing cells in the whole table, as a one-row table."""
    counts = missing_counts(df, list(columns or df.columns))
    return counts.agg(F.coalesce(F.sum("n_missing"), F.lit(0)).cast("bigint").alias("total_missing"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of the finite cells of each column (mean of the two middle values).

    A quantile sketch brackets the median rank; one more pass counts the rows
    below the bracket and the distinct values inside it, which fixes the answer
    exactly. Memory per task is bounded by the sketch, and a value shared by a
    large part of the rows is one counted group. A column whose bracket turns out
    wrong is counted again over a wider one, at last over its full range.
    """
    long = cells(df, columns).filter(F.col("v").isNotNull())
    points = [p for w in _BRACKETS for p in (0.5 - w, 0.5 + w)]
    sketch = F.percentile_approx("v", points, _ACCURACY)
    seen = {r["pos"]: r for r in long.groupBy("pos").agg(F.count("v").alias("n"), sketch.alias("q")).collect()}
    out: dict[str, float | None] = {c: None for c in columns}
    left = dict(seen)
    for k in range(len(_BRACKETS) + 1):
        if not left:
            break
        if k < len(_BRACKETS):
            todo = {p: (r["n"], r["q"][2 * k], r["q"][2 * k + 1]) for p, r in left.items()}
        else:
            todo = {p: (r["n"], _BELOW, float("inf")) for p, r in left.items()}
        found = _rank_in_bracket(long, len(columns), todo)
        for pos, (low, high) in found.items():
            out[columns[pos]] = (low + high) / 2.0
        left = {p: r for p, r in left.items() if p not in found}
    return out


def _rank_in_bracket(
    long: DataFrame, width: int, todo: dict[int, tuple[int, float, float]]
) -> dict[int, tuple[float, float]]:
    """The two middle values of each column in ``todo`` whose bracket holds them."""

    def lookup(at: int, kind: str) -> Column:
        known = (todo[p][at] if p in todo else None for p in range(width))
        values = ("NULL" if v is None else f"{v}" for v in known) if kind == "bigint" else map(double_sql, known)
        return F.element_at(F.expr(array_sql(values)).cast(f"array<{kind}>"), F.col("pos") + F.lit(1))

    low, high, n = lookup(1, "double"), lookup(2, "double"), lookup(0, "bigint")
    counted = (
        long.filter(F.col("v") <= high)
        .select("pos", F.when(F.col("v") < low, F.lit(_BELOW)).otherwise(F.col("v")).alias("v"))
        .groupBy("pos", "v")
        .count()
    )
    running = F.sum("count").over(
        Window.partitionBy("pos").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("upto", running)
    first, second = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    rows = (
        ranked.withColumn("n", n)
        .groupBy("pos")
        .agg(
            F.min(F.when(F.col("upto") >= first, F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") >= second, F.col("v"))).alias("b"),
        )
        .collect()
    )
    return {r["pos"]: (r["a"], r["b"]) for r in rows if r["a"] is not None and r["b"] is not None and r["a"] > _BELOW}


def exact_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Most frequent finite value per column, the smallest one on ties.

    Counting is keyed by ``(column, value)`` so no task ever holds all the
    distinct values of a column.
    """
    counted = cells(df, columns).filter(F.col("v").isNotNull()).groupBy("pos", "v").count()
    best = counted.groupBy("pos").agg(F.max(F.struct("count", (-F.col("v")).alias("neg"))).alias("top"))
    out: dict[str, float | None] = {c: None for c in columns}
    for row in best.collect():
        out[columns[row["pos"]]] = 0.0 - row["top"]["neg"]
    return out


def exact_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    out: dict[str, float | None] = {c: None for c in columns}
    for row in cells(df, columns).groupBy("pos").agg(F.avg("v").alias("m")).collect():
        out[columns[row["pos"]]] = row["m"]
    return out
