"""URL filters as a sort-merge range join in DataFrame operations only.

A URL is looked up under each of its host's suffixes: the key of a suffix is its labels in reverse order, followed by the path.
A rule is the interval of keys that start with its own key, so intervals of one host nest or are apart. Per host, the
start and the end of each interval are marks that name the innermost rule in force from there on; the marks
and the URLs are put in one order and a running "last mark" plays the stack of active rules. Hosts with many URLs
are salted: their URLs are spread over as many sweeps as keep each near SWEEP_ROWS rows and the few marks of
the host are repeated in each. The longest of a URL's matches wins, then the longer host.

Defined results: a null URL or one without "://" has an empty host and path and gets the default verdict; repeated
URLs are judged each; of equal rules the blocking one holds; extra columns are ignored; without rules all get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descria.llm.common import narrow

DEFAULT_VERDICT = "allow"
SWEEP_ROWS = 200


def with_host_and_path(urls: DataFrame) -> DataFrame:
    """Adds host and path to a table with a column url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path})


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _marks(rules: DataFrame) -> DataFrame:
    """(place, at, rule, rule_verdict, n): from ``at`` on, ``rule`` is the innermost one in force (null: none)."""
    own = rules.groupBy("rule_host", "rule_path").agg(F.max(F.struct(F.col("rule_verdict") == "block", "rule_verdict")).alias("v"))
    own = own.select(
        _reversed(F.col("rule_host")).alias("place"),
        F.col("rule_path").alias("path"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("v.rule_verdict").alias("rule_verdict"),
    )
    starts = own.select("place", F.encode("path", "utf-8").alias("at"), F.lit(1).alias("kind"), "rule", "rule_verdict")
    # At its end the rule around it holds again: the longest shorter prefix that is a rule of the same host.
    prefixes = own.select("place", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    prefixes = prefixes.where(F.col("n") < F.length("path")).select("place", "path", F.expr("substring(path, 1, n)").alias("outer"), "n")
    around = own.select("place", F.col("path").alias("outer"), F.col("rule").alias("o_rule"), F.col("rule_verdict").alias("o_verdict"))
    parent = prefixes.join(around, ["place", "outer"]).groupBy("place", "path").agg(F.max_by(F.struct("o_rule", "o_verdict"), "n").alias("o"))
    ends = own.select("place", "path").join(parent, ["place", "path"], "left")
    # No UTF-8 text holds the byte FF, so it stands after all texts with this start. Inner intervals end first.
    ends = ends.select(
        "place", F.concat(F.encode("path", "utf-8"), F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"),
        F.col("o.o_rule").alias("rule"), F.col("o.o_verdict").alias("rule_verdict"),
    )
    return starts.union(ends)


def judge_urls(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``urls``; ``rules``: (rule_host, rule_path, rule_verdict)."""
    pages = with_host_and_path(narrow(urls, id_column, "url"))
    marks = _marks(rules)
    per_host = marks.groupBy("place").agg(F.count(F.lit(1)).alias("n_marks"))
    # Rows are told apart by all that is judged; equal rows get equal results and are multiplied again at the end.
    distinct = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("times")).where("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = distinct.select(
        "host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n_labels"), labels.alias("labels")
    ).select("host", "path", F.array_join(F.slice(F.reverse("labels"), F.lit(1), F.col("n_labels")), ".").alias("place"))
    found = suffixes.join(per_host, "place")  # places with rules only
    sweeps = found.groupBy("place").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(SWEEP_ROWS), F.max("n_marks"))), F.lit(1)).cast("int").alias("sweeps")
    )
    keys = found.join(sweeps, "place").select(
        "place", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("sweep"), F.encode("path", "utf-8").alias("at"),
        F.lit(2).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"), "host", "path",
    )
    spread = marks.join(sweeps, "place").select(
        "place", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), "at", "kind", "rule", "rule_verdict",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    order = Window.partitionBy("place", "sweep").orderBy("at", "kind", F.desc(F.length("rule")))
    in_force = F.last(F.when(F.col("kind") < 2, F.struct("rule", "rule_verdict")), ignorenulls=True).over(order)
    # Said outright: both sides come dealt by place alone, which Spark would take as good enough for the window.
    dealt = keys.union(spread).repartition("place", "sweep")
    swept = dealt.withColumn("now", in_force).where("kind = 2 and now.rule is not null")
    best = swept.groupBy("host", "path").agg(
        F.max(F.struct(F.length("now.rule").alias("n"), F.length("place").alias("m"), "now.rule", "now.rule_verdict")).alias("b")
    )
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(
        id_column, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
