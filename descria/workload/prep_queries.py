"""Cleaning, imputation, column statistics and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.columns import feature_columns, missing_columns, name_at, remaining_columns, require_columns
from descria.columns import select_features as project
from descria.operators import clean, gram, impute, moments, prune
from descria.operators.importance import importance_lasso, importance_rf, score_table
from descria.plans.preparation import optimize_all, preprocess_all, summarise
from descria.workload.fixtures import (
    CUST_FEATURES,
    CUST_SQL,
    EMB,
    EMB_FEATURES,
    EMB_FINITE_SQL,
    EMB_SQL,
    ORD_FEATURES,
    ORD_FILLED_SQL,
    ORD_SQL,
    d_cust,
    d_emb,
    d_ord,
    long_sql,
)
from descria.workload.registry import query

# The 68 columns the row rule counts: features plus both targets, without the key.
COUNTED = [*EMB_FEATURES, "value", "Label"]
DIGITS = 6
# Correlation level used on the matrix: its columns are nearly independent.
LOW = 0.1


def rounded(df: DataFrame, columns: list[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fingerprint of a wide result: count, sum, extremes and a key-weighted sum per column."""
    profile = moments.column_profile(df, columns)
    return rounded(
        profile.select("feature", "n_rows", "n_missing", (F.col("mean") * F.col("n_valid")).alias("total"), "min", "max"),
        ["total", "min", "max"],
    )


SUMMARY_SQL = (
    "SELECT feature, count(*) AS n_rows, count(*) - count(v) AS n_missing, round(sum(v), 6) AS total,"
    ' round(min(v), 6) AS "min", round(max(v), 6) AS "max" FROM cells GROUP BY pos, feature'
)


@query("replace_inf", f"WITH {EMB_FINITE_SQL} SELECT vec_id, {', '.join(EMB_FEATURES)}, value, Label FROM fin")
def replace_inf(spark, sf):
    return clean.replace_inf(d_emb(spark, sf))


@query(
    "inf_report",
    f"WITH {EMB_SQL}, {long_sql('emb', EMB)} SELECT feature AS Feature, count(*) AS Original_Inf_Count"
    " FROM cells WHERE abs(v) = CAST('Infinity' AS DOUBLE) GROUP BY feature",
)
def inf_report(spark, sf):
    return clean.inf_report(d_emb(spark, sf))


_N_MISSING = " + ".join(f"CAST({c} IS NULL AS INT)" for c in COUNTED)
_ROWS_SQL = f"{EMB_FINITE_SQL}, kept AS (SELECT * FROM fin WHERE ({_N_MISSING}) / 68.0 <= 0.5)"


@query("drop_high_nan_rows", f"WITH {_ROWS_SQL} SELECT vec_id, {', '.join(EMB_FEATURES)}, value, Label FROM kept")
def drop_high_nan_rows(spark, sf):
    return clean.drop_high_nan_rows(clean.replace_inf(d_emb(spark, sf)), 0.5, COUNTED)


_FRACTION = "count(*) - count(v)"


@query(
    "drop_high_nan_cols",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', COUNTED)} SELECT feature,"
    f" round(CAST({_FRACTION} AS DOUBLE) / count(*), 6) AS nan_fraction FROM cells GROUP BY pos, feature"
    " HAVING CAST(count(*) - count(v) AS DOUBLE) / count(*) <= 0.5",
)
def drop_high_nan_cols(spark, sf):
    out = clean.drop_high_nan_cols(clean.replace_inf(d_emb(spark, sf)).drop("vec_id"), 0.5)
    return rounded(moments.col_nan_fraction(out), ["nan_fraction"])


@query(
    "col_nan_fraction",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', COUNTED)} SELECT feature,"
    f" round(CAST({_FRACTION} AS DOUBLE) / count(*), 6) AS nan_fraction FROM cells GROUP BY pos, feature",
)
def col_nan_fraction(spark, sf):
    return rounded(moments.col_nan_fraction(clean.replace_inf(d_emb(spark, sf)), COUNTED), ["nan_fraction"])


@query(
    "total_missing",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', COUNTED)} SELECT count(*) - count(v) AS total_missing FROM cells",
)
def total_missing(spark, sf):
    return moments.total_missing(clean.replace_inf(d_emb(spark, sf)), COUNTED)


@query(
    "column_profile",
    f"WITH {EMB_SQL}, {long_sql('emb', EMB_FEATURES)}, f AS (SELECT *, CASE WHEN abs(v) = CAST('Infinity' AS DOUBLE)"
    " THEN NULL ELSE v END AS x FROM cells) SELECT feature, count(*) AS n_rows, count(*) - count(v) AS n_missing,"
    " count(v) - count(x) AS n_inf, count(x) AS n_valid, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance,"
    ' round(min(x), 6) AS "min", round(max(x), 6) AS "max" FROM f GROUP BY pos, feature',
)
def column_profile(spark, sf):
    profile = moments.column_profile(d_emb(spark, sf), EMB_FEATURES).drop("pos")
    return rounded(profile, ["mean", "variance", "min", "max"])


def _impute_sql(aggregate: str) -> str:
    fills = ", ".join(f"{aggregate.format(c=c)} AS {c}" for c in EMB_FEATURES)
    filled = ", ".join(f"round(coalesce(fin.{c}, f.{c}), 6) AS {c}" for c in EMB_FEATURES)
    return f"WITH {EMB_FINITE_SQL}, f AS (SELECT {fills} FROM fin) SELECT vec_id, {filled}, Label FROM fin, f"


def _imputed(spark, sf, strategy):
    out = impute.impute(d_emb(spark, sf).drop("value"), strategy, "classification", protected=["vec_id"])
    return rounded(out.table, EMB_FEATURES)


@query("impute_mean", _impute_sql("avg({c})"))
def impute_mean(spark, sf):
    return _imputed(spark, sf, "mean")


@query("impute_median", _impute_sql("median({c})"))
def impute_median(spark, sf):
    return _imputed(spark, sf, "median")


_MODE_FILLS = (
    f"{long_sql('fin', EMB_FEATURES)}, freq AS (SELECT feature, v, count(*) AS n FROM cells WHERE v IS NOT NULL"
    " GROUP BY feature, v), best AS (SELECT feature, v FROM freq"
    " QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) = 1)"
)


@query(
    "impute_mode",
    f"WITH {EMB_FINITE_SQL}, {_MODE_FILLS} SELECT vec_id, "
    + ", ".join(f"round(coalesce({c}, (SELECT v FROM best WHERE feature = '{c}')), 6) AS {c}" for c in EMB_FEATURES)
    + ", Label FROM fin",
)
def impute_mode(spark, sf):
    return _imputed(spark, sf, "most_frequent")


@query(
    "median_fill_prep",
    f"WITH {ORD_FILLED_SQL} SELECT o_orderkey, {', '.join(f'round({c}, 6) AS {c}' for c in ORD_FEATURES)} FROM ordf",
)
def median_fill_prep(spark, sf):
    out = impute.median_fill_prep(d_ord(spark, sf), ORD_FEATURES)[0].select("o_orderkey", *ORD_FEATURES)
    return rounded(out, ORD_FEATURES)


@query(
    "median_impute_global",
    f"WITH {ORD_FILLED_SQL}, {long_sql('ordf', ORD_FEATURES)} {SUMMARY_SQL.replace('round(sum(v), 6)', 'round(sum(v), 2)')}",
)
def median_impute_global(spark, sf):
    out = impute.median_impute_global(d_ord(spark, sf), ORD_FEATURES)
    return rounded(summary(out.table, ORD_FEATURES), ["total"], 2)


# Row filter, column filter, mean fill; both steps decided by the statement itself.
_KEPT_CELLS = long_sql("kept", EMB_FEATURES, "vec_id")
_PREPARED_SQL = (
    f"{_ROWS_SQL}, {_KEPT_CELLS}, stat AS (SELECT feature, pos, avg(v) AS m,"
    " CAST(count(*) - count(v) AS DOUBLE) / count(*) AS f FROM cells GROUP BY feature, pos)"
)


@query(
    "preprocess_all",
    f"WITH {_PREPARED_SQL} SELECT vec_id, cells.feature, round(coalesce(v, m), 6) AS v"
    " FROM cells JOIN stat ON cells.feature = stat.feature WHERE f <= 0.5",
)
def preprocess(spark, sf):
    out = preprocess_all(d_emb(spark, sf), 0.5, 0.5, "mean", protected=["vec_id", "value"], counted=COUNTED)
    features = [c for c in out.table.columns if c in set(EMB_FEATURES)]
    long = moments.cells(out.table, features, F.col("vec_id"))
    return rounded(long.select("vec_id", name_at(F.col("pos"), features).alias("feature"), "v"), ["v"])


@query(
    "step_report",
    f"WITH {_PREPARED_SQL}, c AS (SELECT (SELECT count(*) FROM fin) AS n, (SELECT count(*) FROM kept) AS k,"
    " CAST((SELECT count(*) FROM stat WHERE f > 0.5) AS INT) AS d), r AS ("
    " SELECT 'replace_inf' AS step, n AS rows_in, n AS rows_out, 69 AS cols_in, 69 AS cols_out FROM c"
    " UNION ALL SELECT 'drop_high_nan_rows', n, k, 69, 69 FROM c"
    " UNION ALL SELECT 'drop_high_nan_cols', k, k, 69, 69 - d FROM c"
    " UNION ALL SELECT 'impute_mean', k, k, 69 - d, 69 - d FROM c)"
    " SELECT step, rows_in, rows_out, rows_in - rows_out AS rows_removed, CAST(cols_in AS INT) AS cols_in,"
    " CAST(cols_out AS INT) AS cols_out, CAST(cols_in - cols_out AS INT) AS cols_removed FROM r",
)
def step_report(spark, sf):
    out = preprocess_all(d_emb(spark, sf), 0.5, 0.5, "mean", protected=["vec_id", "value"], counted=COUNTED)
    return summarise(out.report)


# --- projections and column sets ----------------------------------------------


@query("select_features", f"WITH {ORD_SQL} SELECT o_orderkey, round(ext, 2) AS ext, qty FROM ord")
def select_features(spark, sf):
    return rounded(project(d_ord(spark, sf), ["qty", "ext"], keep=["o_orderkey"]), ["ext"], 2)


@query("require_column", f"WITH {CUST_SQL} SELECT nation, count(*) AS n FROM cust GROUP BY nation")
def require_column(spark, sf):
    checked = require_columns(d_cust(spark, sf), ["nation", "value"])
    return checked.groupBy("nation").agg(F.count("value").alias("n"))


@query(
    "drop_non_numeric",
    "WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer),"
    f" {long_sql('c', ['c_custkey', 'c_nationkey', 'c_acctbal'])}"
    " SELECT feature, count(v) AS n, round(avg(v), 6) AS mean FROM cells GROUP BY pos, feature",
)
def drop_non_numeric(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    numeric = feature_columns(customer, protected=["c_name", "c_mktsegment"])
    profile = moments.column_profile(customer, numeric)
    return rounded(profile.select("feature", F.col("n_valid").alias("n"), "mean"), ["mean"])


_ASKED = [*CUST_FEATURES, *ORD_FEATURES]


@query(
    "missing_columns",
    f"WITH {CUST_SQL}, {long_sql('cust', CUST_FEATURES)} SELECT feature, count(v) AS n FROM cells GROUP BY feature"
    f" UNION ALL SELECT unnest({ORD_FEATURES!r}), NULL",
)
def missing_columns_query(spark, sf):
    cust = d_cust(spark, sf)
    absent = missing_columns(cust, _ASKED)
    present = moments.column_profile(cust, remaining_columns(_ASKED, absent))
    gone = spark.createDataFrame([(c, None) for c in absent], "feature string, n bigint")
    return present.select("feature", F.col("n_valid").alias("n")).unionByName(gone)


@query(
    "remaining_columns",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', EMB_FEATURES)}, p AS (SELECT pos, feature, var_pop(v) AS x FROM cells"
    " GROUP BY pos, feature) SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS pos, feature FROM p WHERE x > 0",
)
def remaining(spark, sf):
    profile = moments.column_profile(d_emb(spark, sf), EMB_FEATURES)
    flat = [r["feature"] for r in profile.filter("variance = 0").select("feature").collect()]
    left = remaining_columns(EMB_FEATURES, flat)
    return spark.createDataFrame(list(enumerate(left)), "pos int, feature string")


# --- variance and correlation -------------------------------------------------


@query(
    "low_variance",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', EMB_FEATURES)} SELECT feature, round(var_pop(v), 6) AS variance"
    " FROM cells GROUP BY pos, feature HAVING var_pop(v) > 0.015",
)
def low_variance(spark, sf):
    out = prune.low_variance(d_emb(spark, sf), EMB_FEATURES, 0.015)
    return rounded(moments.column_profile(out.table, out.kept).select("feature", "variance"), ["variance"])


_TARGETED = [*EMB_FEATURES, "value"]
# Pairwise-complete sums of every pair i < j, on the long form.
_PAIRS_SQL = (
    f"{EMB_FINITE_SQL}, {long_sql('fin', _TARGETED, 'vec_id')}, g AS (SELECT vec_id, pos, v FROM cells"
    " WHERE v IS NOT NULL), pr AS (SELECT a.pos AS i, b.pos AS j, covar_pop(a.v, b.v) AS c, stddev_pop(a.v) AS sa,"
    " stddev_pop(b.v) AS sb FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY a.pos, b.pos),"
    " rr AS (SELECT i, j, CASE WHEN sa > 1e-9 AND sb > 1e-9 THEN c / (sa * sb) END AS r FROM pr),"
    f" nm AS (SELECT unnest(range({len(_TARGETED)})) AS pos, unnest({_TARGETED!r}) AS feature)"
)


@query(
    "corr_matrix",
    f"WITH {_PAIRS_SQL} SELECT a.feature AS f1, b.feature AS f2, round(r, 6) AS r FROM rr"
    f" JOIN nm a ON a.pos = i JOIN nm b ON b.pos = j WHERE j < {len(EMB_FEATURES)}",
)
def corr_matrix(spark, sf):
    return rounded(gram.corr_matrix(d_emb(spark, sf), EMB_FEATURES), ["r"])


@query(
    "corr_pairs_by_group",
    f"WITH {ORD_FILLED_SQL} SELECT a.f1, a.f2, round(a.r, 6) AS r FROM (SELECT unnest(["
    + ", ".join(
        f"{{'f1': '{a}', 'f2': '{b}', 'r': corr({a}, {b})}}"
        for i, a in enumerate(ORD_FEATURES)
        for b in ORD_FEATURES[i + 1 :]
    )
    + "]) AS a FROM ordf)",
)
def corr_orders(spark, sf):
    filled = impute.median_fill_prep(d_ord(spark, sf), ORD_FEATURES)[0]
    return rounded(gram.corr_matrix(filled, ORD_FEATURES), ["r"])


@query(
    "corr_with_target",
    f"WITH {_PAIRS_SQL} SELECT feature, round(coalesce(abs(r), 0), 6) AS abs_r FROM nm"
    f" LEFT JOIN rr ON i = pos AND j = {len(EMB_FEATURES)} WHERE pos < {len(EMB_FEATURES)}",
)
def corr_with_target(spark, sf):
    return rounded(gram.corr_with_target(d_emb(spark, sf), EMB_FEATURES, "value"), ["abs_r"])


_EDGES_SQL = (
    f"{_PAIRS_SQL}, t AS (SELECT pos, round(coalesce(abs(r), 0), 9) AS t FROM nm LEFT JOIN rr ON i = pos AND"
    f" j = {len(EMB_FEATURES)} WHERE pos < {len(EMB_FEATURES)}), ed AS (SELECT i, j, r, a.t AS ti, b.t AS tj FROM rr"
    f" JOIN t a ON a.pos = i JOIN t b ON b.pos = j WHERE j < {len(EMB_FEATURES)} AND abs(r) > {LOW})"
)


@query(
    "pair_self_join",
    f"WITH {_EDGES_SQL} SELECT a.feature AS f1, b.feature AS f2, round(r, 6) AS r FROM ed JOIN nm a ON a.pos = i"
    " JOIN nm b ON b.pos = j",
)
def pair_self_join(spark, sf):
    return rounded(prune.edge_report(d_emb(spark, sf), EMB_FEATURES, LOW), ["r"])


def _kept_sql(edges: str, removed: str) -> str:
    return f"WITH {edges}, gone AS ({removed}) SELECT feature FROM nm WHERE pos < {len(EMB_FEATURES)} AND pos NOT IN (SELECT w FROM gone)"


def _kept(spark, sf, mode, task):
    out = prune.high_correlation(d_emb(spark, sf), EMB_FEATURES, "value", LOW, mode, task)
    return moments.column_profile(out.table, out.kept).select("feature")


@query(
    "high_corr_target_cls",
    _kept_sql(_EDGES_SQL, "SELECT CASE WHEN ti > tj THEN j ELSE i END AS w FROM ed"),
)
def high_corr_target_cls(spark, sf):
    return _kept(spark, sf, "target_based", "classification")


# The greedy pass as a recursion over the ordered edge list, carrying the removed set.
_GREEDY = """no AS (SELECT row_number() OVER (ORDER BY i, j) AS k, i, j, CASE WHEN ti >= tj THEN j ELSE i END AS w FROM ed),
 walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL
  SELECT no.k, CASE WHEN list_contains(gone, no.i) OR list_contains(gone, no.j) THEN gone
   ELSE list_append(gone, no.w) END FROM walk JOIN no ON no.k = walk.k + 1)"""


@query(
    "high_corr_target_reg",
    f"WITH RECURSIVE {_EDGES_SQL}, {_GREEDY}, gone AS (SELECT unnest(gone) AS w FROM walk WHERE k ="
    f" (SELECT max(k) FROM walk)) SELECT feature FROM nm WHERE pos < {len(EMB_FEATURES)} AND pos NOT IN (SELECT w FROM gone)",
)
def high_corr_target_reg(spark, sf):
    return _kept(spark, sf, "target_based", "regression")


@query("high_corr_upper", _kept_sql(_EDGES_SQL, "SELECT j AS w FROM ed"))
def high_corr_upper(spark, sf):
    return _kept(spark, sf, "upper", "regression")


@query("high_corr_lower", _kept_sql(_EDGES_SQL, "SELECT i AS w FROM ed"))
def high_corr_lower(spark, sf):
    return _kept(spark, sf, "lower", "regression")


@query("high_corr_lower_cls", _kept_sql(_EDGES_SQL, "SELECT j AS w FROM ed"))
def high_corr_lower_cls(spark, sf):
    return _kept(spark, sf, "lower", "classification")


@query(
    "optimize_all",
    f"WITH {_EDGES_SQL}, va AS (SELECT pos FROM cells GROUP BY pos HAVING var_pop(v) > 0.014),"
    " gone AS (SELECT CASE WHEN ti > tj THEN j ELSE i END AS w FROM ed WHERE i IN (SELECT pos FROM va)"
    " AND j IN (SELECT pos FROM va))"
    f" SELECT feature FROM nm WHERE pos < {len(EMB_FEATURES)} AND pos IN (SELECT pos FROM va)"
    " AND pos NOT IN (SELECT w FROM gone)",
)
def optimize(spark, sf):
    data = d_emb(spark, sf).drop("Label")
    out = optimize_all(data, 0.014, LOW, task="classification", protected=["vec_id"], target="value")
    return moments.column_profile(out.table, out.kept).select("feature")


_PAIR_LIST = ", ".join(
    f"{{'i': {i}, 'j': {j}, 'r': corr({a}, {b})}}"
    for i, a in enumerate(ORD_FEATURES)
    for j, b in enumerate(ORD_FEATURES)
    if i < j
)
_TARGET_LIST = ", ".join(f"round(abs(corr({c}, value)), 9)" for c in ORD_FEATURES)


@query(
    "optimize_all_regression",
    f"WITH RECURSIVE {ORD_FILLED_SQL}, {long_sql('ordf', ORD_FEATURES)}, st AS (SELECT [{_PAIR_LIST}] AS p,"
    f" [{_TARGET_LIST}] AS t FROM ordf), ed AS (SELECT x.i, x.j, t[x.i + 1] AS ti, t[x.j + 1] AS tj FROM"
    f" (SELECT unnest(p) AS x, t FROM st) WHERE abs(x.r) > 0.7), {_GREEDY}, gone AS (SELECT unnest(gone) AS w FROM walk"
    " WHERE k = (SELECT max(k) FROM walk)) SELECT feature, round(var_pop(v), 2) AS variance FROM cells"
    " WHERE pos NOT IN (SELECT w FROM gone) GROUP BY feature HAVING var_pop(v) > 0.05",
)
def optimize_reg(spark, sf):
    # Every order column varies by more than the threshold, so only correlation decides here.
    out = optimize_all(d_ord(spark, sf).drop("Label"), 0.0, 0.7, task="regression", protected=["o_orderkey"])
    kept = prune.low_variance(out.table, out.kept, 0.05)
    return rounded(moments.column_profile(kept.table, kept.kept).select("feature", "variance"), ["variance"], 2)


@query("importance_lasso")
def importance_lasso_query(spark, sf):
    cust = d_cust(spark, sf)
    return score_table(cust, importance_lasso(cust, CUST_FEATURES, "value", "regression"))


@query("importance_rf")
def importance_rf_query(spark, sf):
    cust = d_cust(spark, sf)
    return score_table(cust, importance_rf(cust, CUST_FEATURES, "Label", "classification"))


# One column: the penalised coefficient is a soft threshold of covariance over variance.
@query(
    "importance_lasso_single",
    f"WITH {CUST_SQL} SELECT CAST(0 AS INT) AS pos, 'avg_price' AS feature, round(greatest(abs(covar_pop(value,"
    " avg_price)) / stddev_pop(avg_price) - 1.0, 0), 4) AS importance FROM cust",
)
def importance_lasso_single(spark, sf):
    cust = d_cust(spark, sf)
    return rounded(score_table(cust, importance_lasso(cust, ["avg_price"], "value", "regression")), ["importance"], 4)
