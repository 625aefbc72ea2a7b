"""Projections that let the operators run on the driver's tables: each table plays a part that its columns can carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders are sessions, their lineitems findings: priority is the severity, discount the doubt, return flag the tier."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    tier = F.when(F.col("l_returnflag") == "A", "OBSERVED").when(F.col("l_returnflag") == "R", "DEDUCED").otherwise("INFERRED")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("session"),
        F.col("o_custkey").alias("server"),
        severity.alias("severity"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.col("l_quantity").cast("int").alias("affected"),
        tier.alias("tier"),
        (F.col("l_linestatus") == "F").alias("adequate"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("seen_at"),
    )


FINDINGS_SQL = """
    SELECT o_orderkey AS session, o_custkey AS server,
           ['critical', 'high', 'medium', 'low', 'info'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS severity,
           1.0::DOUBLE - l_discount AS confidence, CAST(l_quantity AS INTEGER) AS affected,
           CASE l_returnflag WHEN 'A' THEN 'OBSERVED' WHEN 'R' THEN 'DEDUCED' ELSE 'INFERRED' END AS tier,
           l_linestatus = 'F' AS adequate, l_linenumber AS line, l_shipdate AS seen_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as mail sessions: versions, groups, verdicts and tiers by remainders of the key."""
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n % len(values) + 1).cast("int"))
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        k.alias("session"),
        F.col("o_custkey").alias("server"),
        pick(7, "smtp", "imap", "pop3", "unknown").alias("protocol"),
        pick(11, "OBSERVED", "DEDUCED", "INFERRED").alias("protocol_tier"),
        pick(13, "TLS1.3", None, "TLS1.2", "TLS1.0").alias("version"),
        pick(5, "OBSERVED", "INFERRED").alias("version_tier"),
        pick(17, "upgraded", "failed", "rejected", "not_used").alias("verdict"),
        pick(3, "OBSERVED", "NOT_OBSERVABLE").alias("verdict_tier"),
        pick(19, "X25519MLKEM768", "x25519", None).alias("key_group"),
        pick(19, "PQ_HYBRID", "CLASSICAL", "UNKNOWN").alias("group_class"),
        pick(23, "OBSERVED", "DEDUCED", "INFERRED").alias("group_tier"),
        (k % 19 % 3 == 0).alias("hybrid"),
        pick(29, "OBSERVED", "INFERRED").alias("hybrid_tier"),
        (k % 2 == 0).alias("cipher_known"),
        pick(31, "DEDUCED", "NOT_OBSERVABLE").alias("cipher_tier"),
    )


def _pick(n: int, *values: str | None) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{items}][o_orderkey % {n} % {len(values)} + 1]"


SESSIONS_SQL = f"""
    SELECT o_orderkey AS session, o_custkey AS server,
           {_pick(7, "smtp", "imap", "pop3", "unknown")} AS protocol, {_pick(11, "OBSERVED", "DEDUCED", "INFERRED")} AS protocol_tier,
           {_pick(13, "TLS1.3", None, "TLS1.2", "TLS1.0")} AS version, {_pick(5, "OBSERVED", "INFERRED")} AS version_tier,
           {_pick(17, "upgraded", "failed", "rejected", "not_used")} AS verdict, {_pick(3, "OBSERVED", "NOT_OBSERVABLE")} AS verdict_tier,
           {_pick(19, "X25519MLKEM768", "x25519", None)} AS key_group, {_pick(19, "PQ_HYBRID", "CLASSICAL", "UNKNOWN")} AS group_class,
           {_pick(23, "OBSERVED", "DEDUCED", "INFERRED")} AS group_tier, o_orderkey % 19 % 3 = 0 AS hybrid,
           {_pick(29, "OBSERVED", "INFERRED")} AS hybrid_tier, o_orderkey % 2 = 0 AS cipher_known,
           {_pick(31, "DEDUCED", "NOT_OBSERVABLE")} AS cipher_tier
    FROM orders"""


#: The two suites that the projected clients offer.
SUITE_A, SUITE_B = 0xC02F, 0xC030


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitems are sessions of the server l_suppkey: what each client offered, and what the server's policy selected."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    a, b = F.lit(SUITE_A), F.lit(SUITE_B)
    kind, policy, odd = F.col("l_linenumber") % 3, F.col("l_suppkey") % 3, F.col("l_quantity").cast("int") % 2
    offered = F.when(kind == 0, F.array(a, b)).when(kind == 1, F.array(b, a)).otherwise(F.array(b))
    new = F.when(odd == 1, F.array(F.lit(0x0303), F.lit(0x0304))).otherwise(F.array(F.lit(0x0303)))
    rows = items.where(~((policy == 2) & (kind == 2))).select(
        F.col("l_suppkey").alias("server"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("session"), offered.alias("offered"), new.alias("versions"), policy.alias("policy")
    )
    selected = F.when(F.col("policy") == 1, F.element_at("offered", 1)).when(F.array_contains("offered", SUITE_A), SUITE_A).otherwise(SUITE_B)
    torn = (F.col("server") % 7 == 3) & (F.col("session") % 4 == 0)  # servers that don't always choose alike
    version = F.when((F.col("server") % 5 == 0) | torn, 0x0303).otherwise(F.array_max("versions"))
    return rows.select("server", "session", "offered", selected.alias("selected"), "versions", version.alias("version"))


OFFERS_SQL = f"""
    SELECT server, session, offered, versions,
           CASE WHEN policy = 1 THEN offered[1] WHEN list_contains(offered, {SUITE_A}) THEN {SUITE_A} ELSE {SUITE_B} END AS selected,
           CASE WHEN server % 5 = 0 OR (server % 7 = 3 AND session % 4 = 0) THEN {0x0303} ELSE list_max(versions) END AS version
    FROM (SELECT l_suppkey AS server, l_orderkey * 10 + l_linenumber AS session, l_suppkey % 3 AS policy,
                 CASE l_linenumber % 3 WHEN 0 THEN [{SUITE_A}, {SUITE_B}] WHEN 1 THEN [{SUITE_B}, {SUITE_A}] ELSE [{SUITE_B}] END AS offered,
                 CASE WHEN CAST(l_quantity AS INTEGER) % 2 = 1 THEN [{0x0303}, {0x0304}] ELSE [{0x0303}] END AS versions
          FROM lineitem WHERE NOT (l_suppkey % 3 = 2 AND l_linenumber % 3 = 2))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as TCP segments with faults: some turns are lost, some sent twice, some of those with their first byte changed."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", "turn", F.when(F.col("role") == "user", "c2s").otherwise("s2c").alias("dir"), F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("hex"))
    order = Window.partitionBy("conv_id", "dir").orderBy("turn", "hex")
    size = (F.length("hex") / 2).cast("long")
    fault = F.col("conv_id") * 7 + F.col("turn") * 3
    sent = rows.withColumns({"seq": F.sum(size).over(order) - size, "fault": fault}).where("fault % 11 <> 0")
    frame = F.col("conv_id") * 1_000_000 + F.col("turn") * 2
    once = sent.select(F.col("conv_id").alias("flow"), "dir", "seq", frame.alias("frame"), "hex")
    changed = F.when(F.col("fault") % 10 == 0, F.concat(F.lit("23"), F.expr("substring(hex, 3)"))).otherwise(F.col("hex"))
    again = sent.where("fault % 5 = 0").select(F.col("conv_id").alias("flow"), "dir", "seq", (frame + 1).alias("frame"), changed.alias("hex"))
    return once.unionByName(again)


SEGMENTS_SQL = """
    SELECT * EXCLUDE (fault) FROM (
        SELECT conv_id AS flow, dir, seq, conv_id * 1000000 + turn * 2 AS frame, hex, fault FROM sent
        UNION ALL
        SELECT conv_id, dir, seq, conv_id * 1000000 + turn * 2 + 1, CASE WHEN fault % 10 = 0 THEN '23' || substr(hex, 3) ELSE hex END, fault FROM sent WHERE fault % 5 = 0)"""
SENT_SQL = """
    raw AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'c2s' ELSE 's2c' END AS dir, hex(encode(coalesce(text, ''))) AS hex FROM conversations),
    summed AS (SELECT *, CAST(sum(length(hex) // 2) OVER (PARTITION BY conv_id, dir ORDER BY turn, hex ROWS UNBOUNDED PRECEDING) - length(hex) // 2 AS BIGINT) AS seq, conv_id * 7 + turn * 3 AS fault FROM raw),
    sent AS (SELECT * FROM summed WHERE fault % 11 <> 0)"""
