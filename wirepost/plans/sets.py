"""Queries of set operations and comparisons: truth against detections over benchmark and documents, expected against actual over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bridge import table


def truth(s, d):
    """Multiset of keys: each benchmark item by its first word, kept with repeats."""
    return table(s, d, "benchmark").select(F.lower(F.split("text", " ")[0]).alias("k"))


def detected(s, d):
    return table(s, d, "documents").select(F.lower(F.split(F.coalesce("text", F.lit("")), "[ \n]")[0]).alias("k"))


T = "WITH t AS (SELECT lower(string_split(text, ' ')[1]) AS k FROM benchmark), f AS (SELECT lower(string_split_regex(coalesce(text, ''), '[ \\n]')[1]) AS k FROM documents)"


def agg_30(s, d):
    """Precision and recall by multiset counts: keys meet once each, with how often either side has them."""
    a = truth(s, d).groupBy("k").agg(F.count("*").alias("a"))
    b = detected(s, d).groupBy("k").agg(F.count("*").alias("b"))
    met = a.join(b, "k", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    tp = F.sum(F.least("a", "b"))
    return met.agg(tp.alias("tp"), (F.sum("b") - tp).alias("fp"), (F.sum("a") - tp).alias("fn")).withColumns({"precision": F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9), "recall": F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 9)})


def actual(s, d):
    rows = table(s, d, "orders")
    return rows.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("status"))


def jon_22(s, d):
    """Expected facts against actual ones: equal (nulls too), different, missing."""
    expected = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderstatus")).alias("want"))
    met = expected.join(actual(s, d).withColumn("there", F.lit(True)), "id", "left")
    verdict = F.when(F.col("there").isNull(), "missing").when(F.col("want").eqNullSafe(F.col("status")), "equal").otherwise("different")
    return met.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def jon_23(s, d):
    a = table(s, d, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"))
    met = a.join(actual(s, d).withColumnRenamed("status", "b"), "id", "full_outer")
    return met.select(F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "agree").otherwise("differ").alias("side")).groupBy("side").agg(F.count("*").alias("n"))


def set_09(s, d):
    """Customers that two splits of the orders have in common, though splits should keep customers apart."""
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey")
    return rows.where("o_orderkey % 2 = 0").select("o_custkey").intersect(rows.where("o_orderkey % 2 = 1 AND o_custkey % 5 = 0").select("o_custkey"))


def dom_18(s, d):
    """Rows that differ between two reports once the optional column is left out: the second one has other names for some."""
    one = table(s, d, "nation").withColumn("ml", F.lit(1))
    other = F.when(F.col("n_nationkey") % 7 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name"))
    two = table(s, d, "nation").withColumns({"n_name": other, "ml": F.lit(None).cast("int")})
    a, b = one.drop("ml"), two.drop("ml")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


QUERIES = {
    "agg_30": agg_30,
    "dom_18": dom_18,
    "jon_21": lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"),
    "jon_22": jon_22,
    "jon_23": jon_23,
    "set_05": lambda s, d: truth(s, d).intersectAll(detected(s, d)),
    "set_06": lambda s, d: detected(s, d).exceptAll(truth(s, d)),
    "set_09": set_09,
    "src_11": lambda s, d: table(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).distinct(),
    "src_15": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("sha")),
}
ACTUAL = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'changed' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 13 <> 0"
ORACLES = {
    "agg_30": f"""{T}, n AS (SELECT (SELECT count(*) FROM (SELECT k FROM t INTERSECT ALL SELECT k FROM f)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt)
        SELECT tp, nf - tp AS fp, nt - tp AS fn, round(tp / nf, 9) AS precision, round(tp / nt, 9) AS recall FROM n""",
    "dom_18": "SELECT n_nationkey, n_name || x AS n_name, n_regionkey FROM nation, (VALUES (''), ('?')) v(x) WHERE n_nationkey % 7 = 0",
    "jon_21": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "jon_22": f"""WITH a AS ({ACTUAL}), e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS want FROM orders)
        SELECT CASE WHEN a.id IS NULL THEN 'missing' WHEN want IS NOT DISTINCT FROM status THEN 'equal' ELSE 'different' END AS verdict, count(*) AS n FROM e LEFT JOIN a USING (id) GROUP BY ALL""",
    "jon_23": f"""WITH b AS ({ACTUAL}), a AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0)
        SELECT CASE WHEN a.status IS NULL THEN 'only_b' WHEN b.status IS NULL THEN 'only_a' WHEN a.status = b.status THEN 'agree' ELSE 'differ' END AS side, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY ALL""",
    "set_05": f"{T} SELECT k FROM t INTERSECT ALL SELECT k FROM f",
    "set_06": f"{T} SELECT k FROM f EXCEPT ALL SELECT k FROM t",
    "set_09": "SELECT o_custkey FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 2) = 2",
    "src_11": "SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents",
    "src_15": "SELECT page_id, sha256(coalesce(html, '')) AS sha FROM pages",
}
