"""Descriptor-like tables derived from the shared tables, in Spark and as SQL.

Dirty cells are placed by integer arithmetic on the key, so both forms hold the
same cells. The SQL forms are common table expressions to be put after ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64
EMB = [f"e{i:02d}" for i in range(DIM)]
EMB_FEATURES = [*EMB, "k_const", "k_dup"]
CUST_FEATURES = ["n_orders", "sum_price", "avg_price", "min_price", "max_price", "sd_price", "frac_f"]
ORD_FEATURES = ["n_lines", "qty", "disc", "tax", "ext", "max_ext"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- wide matrix with missing and infinite cells ----------------------------


def _gap(i: int | str, key: str = "vec_id") -> str:
    return (
        f"(({key} * 31 + {i} * 17) % 11 = 0 OR ({i} % 16 = 3 AND {key} % 3 <> 0)"
        f" OR ({key} % 25 = 7 AND {i} % 4 <> 0))"
    )


def _cell(i: int, base: int) -> str:
    return (
        f"CASE WHEN {_gap(i)} THEN NULL WHEN (vec_id * 13 + {i} * 7) % 97 = 0"
        f" THEN CAST('Infinity' AS DOUBLE) ELSE CAST(embedding[{i + base}] AS DOUBLE) END AS {EMB[i]}"
    )


def _emb_columns(base: int) -> list[str]:
    first, second = (f"CAST(embedding[{k + base}] AS DOUBLE)" for k in (0, 1))
    return [
        "vec_id",
        *[_cell(i, base) for i in range(DIM)],
        "CAST(7 AS DOUBLE) AS k_const",
        f"{first} * 2 + 1 AS k_dup",
        f"{first} * 3 - {second} AS value",
        "CAST(label % 2 AS BIGINT) AS Label",
    ]


def d_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty cells are made in one array expression; the columns are then lookups."""
    dirty = (
        f"transform(embedding, (x, i) -> CASE WHEN {_gap('i')} THEN NULL"
        " WHEN (vec_id * 13 + i * 7) % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(x AS DOUBLE) END)"
    )
    packed = table(spark, sf_dir, "embeddings").selectExpr("*", f"{dirty} AS cells")
    return packed.selectExpr("vec_id", *[f"cells[{i}] AS {c}" for i, c in enumerate(EMB)], *_emb_columns(0)[DIM + 1 :])


EMB_SQL = f"emb AS (SELECT {', '.join(_emb_columns(1))} FROM embeddings)"
_FINITE = ", ".join(f"CASE WHEN abs({c}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {c} END AS {c}" for c in EMB)
EMB_FINITE_SQL = f"{EMB_SQL}, fin AS (SELECT vec_id, {_FINITE}, k_const, k_dup, value, Label FROM emb)"


def names_sql(columns: list[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in columns) + "]"


def long_sql(source: str, columns: list[str], extra: str = "", name: str = "cells") -> str:
    """CTE ``cells(extra..., pos, feature, v)`` of the given columns."""
    keep = f"{extra}, " if extra else ""
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in columns)
    return (
        f"{name} AS (SELECT {keep}unnest(range({len(columns)})) AS pos, unnest({names_sql(columns)}) AS feature,"
        f" unnest([{values}]) AS v FROM {source})"
    )


# --- per-customer and per-order descriptors ---------------------------------


def d_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.sum("o_totalprice").alias("sum_price"),
        F.avg("o_totalprice").alias("avg_price"),
        F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"),
        F.stddev_pop("o_totalprice").alias("sd_price"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("frac_f"),
    )
    return (
        table(spark, sf_dir, "customer")
        .join(per, "c_custkey", "left")
        .select(
            "c_custkey",
            F.col("c_nationkey").cast("bigint").alias("nation"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in CUST_FEATURES],
            F.col("c_acctbal").alias("value"),
            (F.col("c_acctbal") > 4500).cast("bigint").alias("Label"),
        )
    )


CUST_SQL = """per AS (
  SELECT o_custkey AS c_custkey, CAST(count(*) AS DOUBLE) AS n_orders, sum(o_totalprice) AS sum_price,
         avg(o_totalprice) AS avg_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price,
         stddev_pop(o_totalprice) AS sd_price, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS frac_f
  FROM orders GROUP BY o_custkey),
cust AS (
  SELECT c.c_custkey, CAST(c_nationkey AS BIGINT) AS nation, coalesce(n_orders, 0) AS n_orders,
         coalesce(sum_price, 0) AS sum_price, coalesce(avg_price, 0) AS avg_price,
         coalesce(min_price, 0) AS min_price, coalesce(max_price, 0) AS max_price,
         coalesce(sd_price, 0) AS sd_price, CAST(coalesce(frac_f, 0) AS DOUBLE) AS frac_f,
         c_acctbal AS value, CAST(c_acctbal > 4500 AS BIGINT) AS Label
  FROM customer c LEFT JOIN per ON per.c_custkey = c.c_custkey)"""


def d_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum("l_discount").alias("disc"),
        F.sum("l_tax").alias("tax"),
        F.sum("l_extendedprice").alias("ext"),
        F.max("l_extendedprice").alias("max_ext"),
    )
    return (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .select(
            "o_orderkey",
            F.coalesce("n_lines", F.lit(0.0)).alias("n_lines"),
            *ORD_FEATURES[1:],
            F.col("o_totalprice").alias("value"),
            (F.col("o_orderstatus") == "F").cast("bigint").alias("Label"),
        )
    )


ORD_SQL = """li AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty, sum(l_discount) AS disc,
         sum(l_tax) AS tax, sum(l_extendedprice) AS ext, max(l_extendedprice) AS max_ext
  FROM lineitem GROUP BY l_orderkey),
ord AS (
  SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, qty, disc, tax, ext, max_ext, o_totalprice AS value,
         CAST(o_orderstatus = 'F' AS BIGINT) AS Label
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey)"""

# Missing order cells replaced by exact column medians.
ORD_FILLED_SQL = (
    ORD_SQL
    + ", om AS (SELECT "
    + ", ".join(f"median({c}) AS {c}" for c in ORD_FEATURES)
    + " FROM ord), ordf AS (SELECT o_orderkey, "
    + ", ".join(f"coalesce(ord.{c}, om.{c}) AS {c}" for c in ORD_FEATURES)
    + ", value, Label FROM ord, om)"
)


# --- metric input -------------------------------------------------------------


def d_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").cast("int").alias("y"),
        (1 - F.col("toxic")).cast("int").alias("pred"),
        (1.0 - F.col("toxic")).cast("double").alias("score"),
    )


PRED_SQL = """pred AS (SELECT doc_id, CAST(quality AS INT) AS y, CAST(1 - toxic AS INT) AS pred,
  CAST(1.0 - toxic AS DOUBLE) AS score FROM labels)"""


# --- structures ---------------------------------------------------------------

# Structure texts that cover every rule of the structure filter.
BASES = [
    "CCO", "c1ccccc1", "CC(=O)Oc1ccccc1C(=O)O", "CC(=O)[O-].[Na+]", "[Na+].[Cl-]", "[Fe]", "[Na].[K]",
    "CCn1cccc1", "c1cc[nH]c1", "Clc1ccccc1Br", "[13CH4]", "C[Si](C)(C)C", "O=[N+]([O-])c1ccccc1", "CC(",
    "C1CC", "", "Xy", "c1ccc2ccccc2c1", "N[C@@H](C)C(=O)O", "[Pt](Cl)(Cl)(N)N", "C/C=C/C", "CC%10CCCC%10",
    "[H][H]", "OS(=O)(=O)O",
]


def d_smi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structure per order, in key order: a base text with a chain whose length follows the customer."""
    bases = F.array(*[F.lit(b) for b in BASES])
    base = F.element_at(bases, (F.col("o_orderkey") % len(BASES)).cast("int") + 1)
    chain = F.repeat(F.lit("C"), (F.col("o_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").select(
        "o_orderkey",
        F.concat(chain, base).alias("SMILES"),
        F.col("o_totalprice").alias("value"),
        (F.col("o_orderstatus") == "F").cast("bigint").alias("Label"),
    )


SMI_SQL = (
    "smi AS (SELECT o_orderkey, repeat('C', CAST(o_custkey % 4 AS INT)) || ("
    + names_sql(BASES)
    + f")[CAST(o_orderkey % {len(BASES)} AS INT) + 1] AS SMILES, o_totalprice AS value,"
    " CAST(o_orderstatus = 'F' AS BIGINT) AS Label FROM orders)"
)

SDF_SYMBOLS = ["C", "N", "O", "Cl", "Na", "C"]


def d_sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structure record per order, in key order: a chain of 1 to 6 atoms, sometimes broken, sometimes unreadable."""
    n = (1 + F.col("o_orderkey") % 6).cast("int")
    cut = (F.col("o_custkey") % 5).cast("int")
    symbols = F.array(*[F.lit(s) for s in SDF_SYMBOLS])

    def atom(k):
        symbol = F.element_at(symbols, ((F.col("o_orderkey") + k) % len(SDF_SYMBOLS)).cast("int") + 1)
        return F.format_string(
            "%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0", k.cast("double"), F.lit(0.0), F.lit(0.0), symbol
        )

    links = F.filter(
        F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda k: k != cut,
    )
    bond_lines = F.transform(links, lambda k: F.format_string("%3d%3d%3d  0", k, k + 1, 1 + k % 2))
    counts = F.when(F.col("o_orderkey") % 89 == 7, F.lit("  ?  ?")).otherwise(
        F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", n, F.size(links))
    )
    body = F.concat(
        F.array(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")), F.lit("  derived"), F.lit(""), counts),
        F.transform(F.sequence(F.lit(1), n), atom),
        bond_lines,
        F.array(F.lit("M  END"), F.lit("> <VALUE>"), F.col("o_totalprice").cast("string"), F.lit("")),
    )
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").select(
        "o_orderkey", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("record")
    )


SDF_SQL = """sdf AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey, 'm' || o_orderkey AS title,
         o_orderkey % 89 <> 7 AS valid, CAST(1 + o_orderkey % 6 AS INT) AS n,
         CAST(o_custkey % 5 AS INT) AS cut, o_totalprice
  FROM orders),
sdfx AS (
  SELECT *, CASE WHEN cut BETWEEN 1 AND n - 1 THEN n - 2 ELSE n - 1 END AS m,
         list_transform(range(1, n + 1), lambda k: (['C','N','O','Cl','Na','C'])[CAST((o_orderkey + k) % 6 AS INT) + 1])
           AS symbols
  FROM sdf)"""
