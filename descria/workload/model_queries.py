"""Splits, scaling, metrics, selection, subset search, grid search, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from descria.columns import name_at
from descria.operators import combos, gram, grid, importance, metrics, moments, scale, score, select, split
from descria.operators.linear import fit_least_squares
from descria.sources import sinks
from descria.storage import fresh_path
from descria.workload.fixtures import (
    CUST_FEATURES,
    CUST_SQL,
    EMB,
    EMB_FINITE_SQL,
    ORD_FEATURES,
    ORD_FILLED_SQL,
    PRED_SQL,
    d_cust,
    d_emb,
    d_ord,
    d_pred,
    long_sql,
)
from descria.operators.impute import median_fill_prep
from descria.workload.prep_queries import rounded
from descria.workload.registry import query

SEED = 42


def hash_sql(key: str) -> str:
    return f"md5('{SEED}:' || CAST({key} AS VARCHAR))"


# --- splits and folds -----------------------------------------------------------

# Class shares of the held-out rows by largest remainder, then the smallest hashes per class.
_STRATIFIED = (
    f"{CUST_SQL}, tot AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS k FROM cust),"
    " cls AS (SELECT Label, count(*) AS c FROM cust GROUP BY Label),"
    " base AS (SELECT Label, c * k // n AS b, c * k % n AS rem, k FROM cls, tot),"
    " quota AS (SELECT Label, b + CAST(row_number() OVER (ORDER BY rem DESC, CAST(Label AS VARCHAR))"
    " <= k - sum(b) OVER () AS INT) AS q FROM base),"
    f" rk AS (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY {hash_sql('c_custkey')}) AS rn FROM cust),"
    " marked AS (SELECT rk.*, rn <= q AS is_test FROM rk JOIN quota ON quota.Label = rk.Label)"
)
_RANDOM = (
    f"{CUST_SQL}, tot AS (SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS k FROM cust),"
    f" marked AS (SELECT cust.*, row_number() OVER (ORDER BY {hash_sql('c_custkey')}) <= k AS is_test FROM cust, tot)"
)


@query("split_stratified", f"WITH {_STRATIFIED} SELECT c_custkey, Label, is_test FROM marked")
def split_stratified(spark, sf):
    marked = split.mark_held_out(d_cust(spark, sf), "c_custkey", 0.2, SEED, "Label")
    return marked.select("c_custkey", "Label", "is_test")


@query("split_random", f"WITH {_RANDOM} SELECT c_custkey, is_test FROM marked")
def split_random(spark, sf):
    train, test = split.split_random(d_cust(spark, sf), "c_custkey", 0.2, SEED)
    return train.select("c_custkey", F.lit(False).alias("is_test")).unionByName(
        test.select("c_custkey", F.lit(True).alias("is_test"))
    )


@query(
    "kfold",
    f"SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY {hash_sql('o_orderkey')}) - 1 AS INT) AS fold FROM orders",
)
def kfold(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return split.mark_folds(orders, "o_orderkey", 5, SEED)


@query(
    "kfold_stratified",
    "SELECT o_orderkey, o_orderstatus, CAST(ntile(4) OVER (PARTITION BY o_orderstatus"
    f" ORDER BY {hash_sql('o_orderkey')}) - 1 AS INT) AS fold FROM orders",
)
def kfold_stratified(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return split.mark_folds(orders, "o_orderkey", 4, SEED, "o_orderstatus")


def _scaled_sql(offset: str, width: str) -> str:
    s = ", ".join(f"{offset}({c}) AS o_{c}, {width.format(c=c)} AS w_{c}" for c in CUST_FEATURES)
    z = ", ".join(f"round(({c} - o_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END, 6) AS {c}" for c in CUST_FEATURES)
    return f"WITH {CUST_SQL}, s AS (SELECT {s} FROM cust) SELECT c_custkey, {z} FROM cust, s"


@query("scale_standard", _scaled_sql("avg", "stddev_pop({c})"))
def scale_standard(spark, sf):
    out = scale.scale_standard(d_cust(spark, sf), CUST_FEATURES)
    return rounded(out.select("c_custkey", *CUST_FEATURES), CUST_FEATURES)


@query("scale_minmax", _scaled_sql("min", "max({c}) - min({c})"))
def scale_minmax(spark, sf):
    out = scale.scale_minmax(d_cust(spark, sf), CUST_FEATURES)
    return rounded(out.select("c_custkey", *CUST_FEATURES), CUST_FEATURES)


# --- metrics ----------------------------------------------------------------------


@query(
    "confusion",
    f"WITH {PRED_SQL} SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,"
    " count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM pred",
)
def confusion(spark, sf):
    return metrics.confusion(d_pred(spark, sf), "y", "pred")


def auc_sql(source: str, y: str, s: str) -> str:
    """Rank form of the tie-aware area."""
    return (
        f"(SELECT sum(p * (cum - n + n / 2.0)) / (sum(p) * sum(n)) FROM (SELECT p, n, sum(n) OVER (ORDER BY s) AS cum"
        f" FROM (SELECT {s} AS s, CAST(count(*) FILTER ({y} = 1) AS DOUBLE) AS p,"
        f" CAST(count(*) FILTER ({y} = 0) AS DOUBLE) AS n FROM {source} GROUP BY {s})))"
    )


def class_metrics_sql(source: str, y: str, p: str, auc: str) -> str:
    return (
        f"cm AS (SELECT CAST(count(*) FILTER ({y} = 0 AND {p} = 0) AS DOUBLE) AS tn,"
        f" CAST(count(*) FILTER ({y} = 0 AND {p} = 1) AS DOUBLE) AS fp,"
        f" CAST(count(*) FILTER ({y} = 1 AND {p} = 0) AS DOUBLE) AS fn,"
        f" CAST(count(*) FILTER ({y} = 1 AND {p} = 1) AS DOUBLE) AS tp FROM {source}),"
        " mm AS (SELECT unnest(['accuracy', 'f1_score', 'precision', 'recall', 'specificity', 'roc_auc']) AS metric,"
        " unnest([(tp + tn) / (tp + tn + fp + fn), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0),"
        " coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),"
        f" coalesce(tn / nullif(tn + fp, 0), 0), {auc}]) AS value FROM cm)"
    )


@query(
    "metrics_cls",
    f"WITH {PRED_SQL}, {class_metrics_sql('pred', 'y', 'pred', auc_sql('pred', 'y', 'score'))}"
    " SELECT metric, round(value, 6) AS value FROM mm",
)
def metrics_cls(spark, sf):
    return rounded(metrics.metrics_cls(d_pred(spark, sf), "y", "pred", "score"), ["value"])


@query(
    "roc_auc",
    f"WITH {ORD_FILLED_SQL} SELECT round({auc_sql('ordf', 'Label', 'value')}, 6) AS roc_auc",
)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(d_ord(spark, sf), "Label", "value"), ["roc_auc"])


def value_metrics_sql(source: str, y: str, p: str) -> str:
    return (
        f"vm AS (SELECT unnest(['r2_score', 'mse', 'rmse', 'mae', 'mape']) AS metric, unnest(["
        f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)), avg(({y} - {p}) * ({y} - {p})),"
        f" sqrt(avg(({y} - {p}) * ({y} - {p}))), avg(abs({y} - {p})),"
        f" avg(abs({y} - {p}) / abs({y})) FILTER (abs({y}) > 1e-8) * 100]) AS value FROM {source})"
    )


@query(
    "metrics_reg",
    f"WITH {ORD_FILLED_SQL}, {value_metrics_sql('ordf', 'value', 'ext')} SELECT metric, round(value, 3) AS value FROM vm",
)
def metrics_reg(spark, sf):
    filled, _ = median_fill_prep(d_ord(spark, sf), ORD_FEATURES)
    return rounded(metrics.metrics_reg(filled, "value", "ext"), ["value"], 3)


@query(
    "predictions_table",
    f"WITH {PRED_SQL} SELECT y AS Actual, pred AS Predicted, score AS Probability_Class1 FROM pred",
)
def predictions_table(spark, sf):
    return metrics.predictions_cls(d_pred(spark, sf), "y", "pred", "score")


# --- selection --------------------------------------------------------------------


def _clean_emb(spark, sf):
    """Finite matrix without the two synthetic columns, key kept."""
    return median_fill_prep(d_emb(spark, sf), EMB)[0].drop("k_const", "k_dup")


@query("fs_lasso_cls")
def fs_lasso_cls(spark, sf):
    out = select.select_by_model(
        d_cust(spark, sf).drop("value", "nation"), "Lasso", "Label", alpha=0.01, protected=["c_custkey"]
    )
    return importance.score_table(out.table, out.scores)


# On one 0/1 column the penalised fit has a closed form: each side's share of ones moves towards the other by alpha over its rows.
@query(
    "fs_lasso_cls_single",
    f"WITH {CUST_SQL}, x AS (SELECT CAST(n_orders > 10 AS INT) AS x, Label AS y FROM cust),"
    " g AS (SELECT avg(y) FILTER (x = 1) AS p1, avg(y) FILTER (x = 0) AS p0, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0 FROM x),"
    " m AS (SELECT sign(p1 - p0) AS s, p1 - sign(p1 - p0) * 0.5 / n1 AS q1, p0 + sign(p1 - p0) * 0.5 / n0 AS q0 FROM g)"
    " SELECT CAST(0 AS INT) AS pos, 'many' AS feature,"
    " round(CASE WHEN s * (q1 - q0) > 0 THEN abs(ln(q1 / (1 - q1)) - ln(q0 / (1 - q0))) ELSE 0 END, 5) AS importance FROM m",
)
def fs_lasso_cls_single(spark, sf):
    data = d_cust(spark, sf).select("c_custkey", (F.col("n_orders") > 10).cast("double").alias("many"), "Label")
    out = select.select_by_model(data, "Lasso", "Label", alpha=0.5, protected=["c_custkey"])
    return rounded(importance.score_table(out.table, out.scores), ["importance"], 5)


@query("fs_lasso_reg")
def fs_lasso_reg(spark, sf):
    out = select.select_by_model(
        _clean_emb(spark, sf).drop("Label"), "Lasso", "value", "regression", alpha=0.01, protected=["vec_id"]
    )
    return out.table


@query("fs_tree")
def fs_tree(spark, sf):
    out = select.select_by_model(
        d_ord(spark, sf).drop("Label"), "RandomForest", "value", "regression", threshold=0.01,
        protected=["o_orderkey"],
    )
    return importance.score_table(out.table, out.scores)


@query("fs_boosted")
def fs_boosted(spark, sf):
    out = select.select_by_model(
        _clean_emb(spark, sf).drop("value"), "XGBoost", "Label", threshold="percentile(75)",
        protected=["vec_id"],
    )
    return importance.score_table(out.table, out.scores)


@query("fs_rfe")
def fs_rfe(spark, sf):
    out = select.select_by_model(
        _clean_emb(spark, sf).drop("Label"), "RFE", "value", "regression", "Lasso", n_features=10, alpha=0.001,
        protected=["vec_id"],
    )
    return out.table


@query("fs_from_model")
def fs_from_model(spark, sf):
    out = select.select_by_model(
        _clean_emb(spark, sf).drop("Label"), "SelectFromModel", "value", "regression", "DecisionTree",
        threshold="mean", protected=["vec_id"],
    )
    return importance.score_table(out.table, out.scores)


# Scores whose values SQL can reproduce: absolute correlation with the target.
_SCORES_SQL = (
    f"{CUST_SQL}, sc AS (SELECT unnest({CUST_FEATURES!r}) AS feature, unnest(["
    + ", ".join(f"abs(corr({c}, value))" for c in CUST_FEATURES)
    + "]) AS importance FROM cust)"
)


def _corr_scores(spark, sf):
    table = gram.corr_with_target(d_cust(spark, sf), CUST_FEATURES, "value")
    values = {r["feature"]: r["abs_r"] for r in table.collect()}
    return importance.score_table(table, {c: values[c] for c in CUST_FEATURES})


@query(
    "threshold_expr",
    f"WITH {_SCORES_SQL}, pos AS (SELECT * FROM sc WHERE importance > 0)"
    " SELECT 'percentile(60)' AS expr, round(quantile_cont(importance, 0.6), 6) AS threshold FROM sc"
    " UNION ALL SELECT 'median', round(median(importance), 6) FROM pos"
    " UNION ALL SELECT 'mean', round(avg(importance), 6) FROM pos"
    " UNION ALL SELECT '25%', round(quantile_cont(importance, 0.25), 6) FROM pos"
    " UNION ALL SELECT '1.25*mean', round(1.25 * avg(importance), 6) FROM pos",
)
def threshold_expr(spark, sf):
    scores = _corr_scores(spark, sf)
    asked = [("percentile(60)", "classification"), *[(e, "regression") for e in ("median", "mean", "25%", "1.25*mean")]]
    parts = [select.threshold_expr(scores, e, task).select(F.lit(e).alias("expr"), "threshold") for e, task in asked]
    return rounded(metrics.stack(parts), ["threshold"])


@query(
    "fs_empty_policy",
    f"WITH {CUST_SQL} SELECT c_custkey, Label, {', '.join(f'round({c}, 6) AS {c}' for c in CUST_FEATURES)} FROM cust",
)
def fs_empty_policy(spark, sf):
    """No correlation reaches 0.9, so classification falls back to all features."""
    cust = d_cust(spark, sf)
    chosen = select.at_or_above(_corr_scores(spark, sf), 0.9, positive_only=False)
    kept, _ = select.apply_empty_policy(chosen, CUST_FEATURES, "classification")
    out = select.selection_output(cust, kept, "Label", "classification", ["c_custkey"])
    return rounded(out, CUST_FEATURES)


@query(
    "fs_output",
    f"WITH {_SCORES_SQL}, {long_sql('cust', CUST_FEATURES, 'c_custkey')} SELECT c_custkey, feature, round(v, 6) AS v"
    " FROM cells WHERE feature IN (SELECT feature FROM sc WHERE importance >= (SELECT avg(importance) FROM sc))",
)
def fs_output(spark, sf):
    chosen = select.at_or_above(_corr_scores(spark, sf), "mean", positive_only=False)
    out = select.selection_output(d_cust(spark, sf), chosen, "value", "regression", ["c_custkey"])
    return _melt(out, chosen)


def _melt(df, features):
    long = moments.cells(df, features, F.col("c_custkey"))
    return rounded(long.select("c_custkey", name_at(F.col("pos"), features).alias("feature"), "v"), ["v"])


# --- subset search ------------------------------------------------------------------


@query(
    "combo_enumerate",
    f"WITH {CUST_SQL}, {long_sql('cust', CUST_FEATURES)}, f AS (SELECT pos, avg(v) AS m FROM cells GROUP BY pos),"
    " one AS (SELECT [pos] AS c, m FROM f), two AS (SELECT list_append(c, f.pos) AS c, one.m + f.m AS m FROM one"
    " JOIN f ON f.pos > c[-1]), three AS (SELECT list_append(c, f.pos) AS c, two.m + f.m AS m FROM two"
    " JOIN f ON f.pos > c[-1]) SELECT CAST(len(c) AS INT) AS num_features, array_to_string(c, ',') AS combo,"
    " round(m, 2) AS total_mean FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)",
)
def combo_enumerate(spark, sf):
    """All subsets up to three features with the sum of their column means."""
    subsets = combos.combo_enumerate(spark, len(CUST_FEATURES), 3)
    means = moments.column_profile(d_cust(spark, sf), CUST_FEATURES).select("pos", "mean")
    long = subsets.select("num_features", "combo", F.explode("combo").alias("pos")).join(means, "pos")
    total = long.groupBy("num_features", "combo").agg(F.round(F.sum("mean"), 2).alias("total_mean"))
    return total.select("num_features", F.array_join("combo", ",").alias("combo"), "total_mean")


def _ols_sql() -> str:
    """Held-out R2 and scaled MSE of every one- and two-column model, from normal equations."""
    one, two = [], []
    n = len(CUST_FEATURES)
    for i, a in enumerate(CUST_FEATURES):
        one.append(
            f"SELECT 1 AS k, [{i}] AS combo, regr_slope(value, {a}) FILTER (NOT is_test) AS b1, 0.0 AS b2,"
            f" regr_intercept(value, {a}) FILTER (NOT is_test) AS b0, '{a}' AS fa, '{a}' AS fb FROM marked"
        )
        for j in range(i + 1, n):
            b = CUST_FEATURES[j]
            t = "FILTER (NOT is_test)"
            two.append(
                f"SELECT 2 AS k, [{i}, {j}] AS combo, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1,"
                f" (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2, my - b1 * m1 - b2 * m2 AS b0, '{a}' AS fa,"
                f" '{b}' AS fb FROM (SELECT covar_pop(value, {a}) {t} AS c1, covar_pop(value, {b}) {t} AS c2,"
                f" covar_pop({a}, {b}) {t} AS c12, var_pop({a}) {t} AS v1, var_pop({b}) {t} AS v2,"
                f" avg({a}) {t} AS m1, avg({b}) {t} AS m2, avg(value) {t} AS my FROM marked)"
            )
    values = "CASE {s} " + " ".join(f"WHEN '{c}' THEN {c}" for c in CUST_FEATURES) + " END"
    pred = f"b0 + b1 * {values.format(s='fa')} + b2 * {values.format(s='fb')}"
    return (
        f"{_RANDOM}, fits AS ({' UNION ALL '.join([*one, *two])}),"
        f" sc AS (SELECT k, combo, value AS y, {pred} AS p FROM fits, marked WHERE is_test),"
        " w AS (SELECT max(value) - min(value) AS width FROM cust), ev AS (SELECT k AS num_features, combo,"
        " 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2,"
        " avg((y - p) * (y - p)) / (SELECT width * width FROM w) AS mse FROM sc GROUP BY k, combo)"
    )


_OLS_SQL = _ols_sql()


def _lr_scores(spark, sf, max_features=2):
    cust = d_cust(spark, sf)
    marked = split.mark_held_out(cust, "c_custkey", 0.2, SEED)
    return combos.combo_eval_lr(marked, CUST_FEATURES, "value", F.col("is_test"), max_features)


@query(
    "combo_eval_lr",
    f"WITH {_OLS_SQL} SELECT CAST(num_features AS INT) AS num_features, array_to_string(combo, ',') AS combo,"
    " round(r2, 6) AS r2, round(mse, 6) AS mse FROM ev",
)
def combo_eval_lr(spark, sf):
    return rounded(_lr_scores(spark, sf).withColumn("combo", F.array_join("combo", ",")), ["r2", "mse"])


@query("combo_eval_lr_all")
def combo_eval_lr_all(spark, sf):
    """Subsets of up to five columns, as the operator's default; ``combo_eval_lr`` has the sizes its SQL solves."""
    return rounded(_lr_scores(spark, sf, 5).withColumn("combo", F.array_join("combo", ",")), ["r2", "mse"])


@query(
    "best_per_size",
    f"WITH {_OLS_SQL} SELECT CAST(num_features AS INT) AS num_features, array_to_string(combo, ',') AS combo,"
    " round(r2, 6) AS r2 FROM ev QUALIFY row_number() OVER (PARTITION BY num_features ORDER BY r2 DESC, combo) = 1",
)
def best_per_size(spark, sf):
    best = combos.best_per_size(_lr_scores(spark, sf), "r2")
    return rounded(best.select("num_features", F.array_join("combo", ",").alias("combo"), "r2"), ["r2"])


@query("best_per_size_all")
def best_per_size_all(spark, sf):
    best = combos.best_per_size(_lr_scores(spark, sf, 5), "r2")
    return rounded(best.select("num_features", F.array_join("combo", ",").alias("combo"), "r2"), ["r2"])


_TOP_SQL = f"{_OLS_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY r2 DESC, num_features, combo) AS rk FROM ev)"


@query(
    "combo_topn",
    f"WITH {_TOP_SQL} SELECT CAST(rk AS INT) AS rank, array_to_string(combo, ',') AS combo, round(r2, 6) AS r2"
    " FROM top WHERE rk <= 3",
)
def combo_topn(spark, sf):
    top = combos.combo_topn(_lr_scores(spark, sf), "r2", 3)
    return rounded(top.select("rank", F.array_join("combo", ",").alias("combo"), "r2"), ["r2"])


@query("combo_topn_all")
def combo_topn_all(spark, sf):
    top = combos.combo_topn(_lr_scores(spark, sf, 5), "r2", 3)
    return rounded(top.select("rank", F.array_join("combo", ",").alias("combo"), "r2"), ["r2"])


@query(
    "combo_project",
    f"WITH {_TOP_SQL}, {long_sql('cust', CUST_FEATURES, 'c_custkey')} SELECT c_custkey, feature, round(v, 6) AS v"
    " FROM cells JOIN top ON rk = 1 AND list_contains(combo, pos)",
)
def combo_project(spark, sf):
    best = combos.combo_topn(_lr_scores(spark, sf), "r2", 1).first()
    out = combos.combo_project(d_cust(spark, sf), CUST_FEATURES, best["combo"], "value", ["c_custkey"])
    return _melt(out, [CUST_FEATURES[k] for k in best["combo"]])


@query("combo_project_all")
def combo_project_all(spark, sf):
    best = combos.combo_topn(_lr_scores(spark, sf, 5), "r2", 1).first()
    out = combos.combo_project(d_cust(spark, sf), CUST_FEATURES, best["combo"], "value", ["c_custkey"])
    return _melt(out, [CUST_FEATURES[k] for k in best["combo"]])


@query(
    "combo_skip_rules",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', ['k_const', 'e00', 'k_dup'])}, f AS (SELECT pos, var_pop(v) > 0 AS ok"
    " FROM cells GROUP BY pos), s AS (SELECT [pos] AS c, ok FROM f UNION ALL SELECT [a.pos, b.pos], a.ok OR b.ok"
    " FROM f a JOIN f b ON a.pos < b.pos) SELECT array_to_string(c, ',') AS combo FROM s WHERE ok",
)
def combo_skip_rules(spark, sf):
    """Subsets of constant columns only are not scored."""
    features = ["k_const", "e00", "k_dup"]
    data, _ = median_fill_prep(d_emb(spark, sf), features)
    marked = split.mark_held_out(data, "vec_id", 0.2, SEED)
    scored = combos.combo_eval_lr(marked, features, "value", F.col("is_test"), 2)
    return scored.select(F.array_join("combo", ",").alias("combo"))


@query("combo_eval_rf")
def combo_eval_rf(spark, sf):
    marked = split.mark_held_out(d_cust(spark, sf), "c_custkey", 0.2, SEED)
    listed = (r["combo"] for r in combos.combo_enumerate(spark, len(CUST_FEATURES)).toLocalIterator())
    out = combos.combo_eval_rf(marked, CUST_FEATURES, "value", F.col("is_test"), listed)
    return out.withColumn("combo", F.array_join("combo", ","))


@query("combo_eval_logit")
def combo_eval_logit(spark, sf):
    marked = split.mark_held_out(d_cust(spark, sf), "c_custkey", 0.2, SEED, "Label")
    out = combos.combo_eval_logit(marked, CUST_FEATURES, "Label", F.col("is_test"))
    return out.withColumn("combo", F.array_join("combo", ","))


# --- grid search and validation -------------------------------------------------------


@query(
    "param_grid",
    f"WITH {_STRATIFIED}, tr AS (SELECT count(*) AS n FROM marked WHERE NOT is_test)"
    " SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS param_id, c AS \"C\", n,"
    " round(1.0 / (c * n), 9) AS reg_param"
    " FROM tr, (SELECT CAST(unnest([0.01, 0.1, 1, 10, 100]) AS DOUBLE) AS c)",
)
def param_grid(spark, sf):
    """Candidates of the logistic grid with the penalty each means for this training set."""
    train, _ = split.split_stratified(d_cust(spark, sf), "c_custkey", "Label", 0.2, SEED)
    table = grid.param_table(spark, grid.param_grid("logistic", "classification"))
    options = F.collect_list(F.struct("param_id", F.col("params")["C"].cast("double").alias("C"))).alias("o")
    packed = [tuple(x) for x in table.agg(options).first()["o"]]
    listed = F.array(*[F.struct(F.lit(i).alias("param_id"), F.lit(c).alias("C")) for i, c in packed])
    counted = train.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(listed).alias("x"))
    return counted.select("x.param_id", "x.C", "n", F.round(1.0 / (F.col("x.C") * F.col("n")), 9).alias("reg_param"))


@query("grid_search_cls")
def grid_search_cls(spark, sf):
    out = grid.grid_search_cls(d_cust(spark, sf).drop("value", "nation"), "c_custkey", algorithm="logistic")
    return grid.mean_scores(out.cv_results)


# One standardised column: the elastic-net coefficient is a soft threshold of the
# covariance, shrunk by the quadratic part, so SQL can run the whole search.
_EN_SQL = (
    f"{_RANDOM}, tr AS (SELECT avg_price AS x, value AS y, ntile(5) OVER (ORDER BY {hash_sql('c_custkey')}) - 1 AS fold"
    " FROM marked WHERE NOT is_test), pr AS (SELECT row_number() OVER (ORDER BY al, ra) - 1 AS param_id, al * ra AS l1,"
    " al * (1 - ra) AS l2 FROM (SELECT unnest([0.0, 0.1, 1.0]) AS al), (SELECT unnest([0.1, 0.5, 0.9]) AS ra)),"
    " st AS (SELECT f.fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) AS b"
    " FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY f.fold),"
    " fit AS (SELECT param_id, fold, mx, my, sign(b) * greatest(abs(b) - l1, 0) / (1 + l2) / sx AS w FROM st, pr),"
    " sc AS (SELECT fit.param_id, fit.fold, CASE WHEN tr.fold = fit.fold THEN 'test' ELSE 'train' END AS split, y,"
    " my + w * (x - mx) AS p FROM fit, tr), ev AS (SELECT param_id, fold, split,"
    " 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, -avg((y - p) * (y - p)) AS nm FROM sc"
    " GROUP BY param_id, fold, split)"
)


@query(
    "grid_search_reg",
    f"WITH {_EN_SQL} SELECT CAST(param_id AS INT) AS param_id, split, 'R2' AS metric, round(avg(r2), 6) AS mean_value"
    " FROM ev GROUP BY param_id, split UNION ALL SELECT CAST(param_id AS INT), split, 'Neg_MSE', round(avg(nm), 2)"
    " FROM ev GROUP BY param_id, split",
)
def grid_search_reg(spark, sf):
    data = d_cust(spark, sf).select("c_custkey", "avg_price", "value")
    out = grid.grid_search_reg(data, "c_custkey", algorithm="elasticnet", cv_splits=5)
    digits = F.when(F.col("metric") == "R2", F.round("mean_value", 6)).otherwise(F.round("mean_value", 2))
    return grid.mean_scores(out.cv_results).withColumn("mean_value", digits)


@query("grid_search_reg_all")
def grid_search_reg_all(spark, sf):
    """All columns; ``grid_search_reg`` has the one its SQL solves."""
    out = grid.grid_search_reg(d_cust(spark, sf).drop("Label", "nation"), "c_custkey", algorithm="elasticnet")
    return grid.mean_scores(out.cv_results)


@query("grid_search_elasticnet")
def grid_search_elasticnet(spark, sf):
    """All order columns; the solver is checked against coordinate descent in the tests."""
    out = grid.grid_search_reg(d_ord(spark, sf).drop("Label"), "o_orderkey", algorithm="elasticnet", cv_splits=5)
    return grid.mean_scores(out.cv_results)


@query("grid_search_tree")
def grid_search_tree(spark, sf):
    out = grid.grid_search_reg(d_cust(spark, sf).drop("Label", "nation"), "c_custkey", algorithm="decision_tree")
    return grid.mean_scores(out.cv_results)


# One feature: slope and intercept of every training set are SQL aggregates.
_CV_SQL = (
    f"{_RANDOM}, tr AS (SELECT avg_price AS x, value AS y, ntile(5) OVER (ORDER BY {hash_sql('c_custkey')}) - 1 AS fold"
    " FROM marked WHERE NOT is_test), fit AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a"
    " FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY f.fold),"
    " ev AS (SELECT fit.fold, 1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)) AS r2,"
    " -avg((y - a - b * x) * (y - a - b * x)) AS nm FROM fit JOIN tr ON tr.fold = fit.fold GROUP BY fit.fold)"
)


@query(
    "cv_results",
    f"WITH {_CV_SQL} SELECT CAST(fold AS INT) AS fold, 'R2' AS metric, round(r2, 6) AS value FROM ev"
    " UNION ALL SELECT CAST(fold AS INT), 'Neg_MSE', round(nm, 3) FROM ev",
)
def cv_results(spark, sf):
    data = d_cust(spark, sf).select("c_custkey", "avg_price", "value")
    out = grid.grid_search_reg(data, "c_custkey", algorithm="linear_regression")
    test = out.cv_results.filter("split = 'test'")
    digits = F.when(F.col("metric") == "R2", F.round("value", 6)).otherwise(F.round("value", 3))
    return test.select("fold", "metric", digits.alias("value"))


@query("cv_results_all")
def cv_results_all(spark, sf):
    out = grid.grid_search_reg(d_cust(spark, sf).drop("Label", "nation"), "c_custkey", algorithm="linear_regression")
    return out.cv_results.filter("split = 'test'").select("fold", "metric", "value")


_FIT = "regr_slope(value, avg_price) AS b, regr_intercept(value, avg_price) AS a"
_HELD_SQL = (
    f"{_RANDOM}, fit AS (SELECT {_FIT} FROM marked WHERE NOT is_test),"
    " held AS (SELECT c_custkey, value AS y, a + b * avg_price AS p FROM marked, fit WHERE is_test)"
)


@query("test_artifacts", f"WITH {_HELD_SQL} SELECT c_custkey, round(y, 2) AS value, 'avg_price' AS features FROM held")
def test_artifacts(spark, sf):
    data = d_cust(spark, sf).select("c_custkey", "avg_price", "value")
    out = grid.grid_search_reg(data, "c_custkey", algorithm="ridge", grid={"alpha": [0, 1.0]})
    held = out.held_out.select("c_custkey", F.round("value", 2).alias("value"))
    return held.withColumn("features", F.lit(",".join(out.features)))


@query(
    "validate_reg",
    f"WITH {_HELD_SQL}, {value_metrics_sql('held', 'y', 'p')} SELECT metric, round(value, 3) AS value FROM vm",
)
def validate_reg(spark, sf):
    train, held = split.split_random(d_cust(spark, sf), "c_custkey", 0.2, SEED)
    model = fit_least_squares(train, ["avg_price"], "value")
    return rounded(score.validate_reg(model, held, ["avg_price"], "value").metrics, ["value"], 3)


@query("validate_reg_all")
def validate_reg_all(spark, sf):
    train, held = split.split_random(d_cust(spark, sf), "c_custkey", 0.2, SEED)
    model = fit_least_squares(train, CUST_FEATURES, "value")
    return score.validate_reg(model, held, CUST_FEATURES, "value").metrics


@query(
    "validate_reg_predictions",
    f"WITH {_HELD_SQL} SELECT round(y, 2) AS Actual_value, round(p, 4) AS Predicted FROM held",
)
def validate_reg_predictions(spark, sf):
    train, held = split.split_random(d_cust(spark, sf), "c_custkey", 0.2, SEED)
    model = fit_least_squares(train, ["avg_price"], "value")
    out = score.validate_reg(model, held, ["avg_price"], "value").predictions
    return rounded(rounded(out, ["Actual_value"], 2), ["Predicted"], 4)


@query("validate_cls")
def validate_cls(spark, sf):
    data = d_cust(spark, sf).drop("value", "nation")
    out = grid.grid_search_cls(data, "c_custkey", algorithm="logistic")
    return score.validate_cls(out.model, out.held_out, out.features, "Label").metrics


@query(
    "sink_model",
    f"WITH {_HELD_SQL} SELECT c_custkey, round(p, 4) AS prediction, 'linear_regression' AS algorithm FROM held",
)
def sink_model(spark, sf):
    """Save, load and score again."""
    return _saved_and_scored(spark, sf, ["avg_price"])


@query("sink_model_all")
def sink_model_all(spark, sf):
    return _saved_and_scored(spark, sf, CUST_FEATURES)


def _saved_and_scored(spark, sf, features):
    train, held = split.split_random(d_cust(spark, sf), "c_custkey", 0.2, SEED)
    model = fit_least_squares(train, features, "value")
    path = sinks.sink_model(model, fresh_path(spark, "model"), {}, "linear_regression")
    algorithm = sinks.load_params(spark, path)["algorithm"]
    out = sinks.load_model(path).transform(held).select("c_custkey", F.round("prediction", 4).alias("prediction"))
    return out.withColumn("algorithm", F.lit(algorithm))
