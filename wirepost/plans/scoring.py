"""Queries of the scoring operators over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as f
from ..operators import scoring
from .bridge import FINDINGS_SQL, SESSIONS_SQL, findings, sessions

RISK = ("OBSERVED", "DEDUCED")
FACTS = f"WITH f AS ({FINDINGS_SQL})"
SESS = f"""WITH s AS ({SESSIONS_SQL}),
    e AS (SELECT *, version IS NOT NULL AND version_tier IN {RISK} AS encrypted,
                 protocol IN ('smtp', 'imap', 'pop3') AND protocol_tier IN {RISK} AND version IS NULL
                 AND verdict <> 'upgraded' AND (verdict <> 'failed' OR verdict_tier IN {RISK}) AS cleartext,
                 hybrid AND hybrid_tier IN {RISK} AND key_group IS NOT NULL AND group_class <> 'UNKNOWN' AS safe
          FROM s),
    o AS (SELECT *, cleartext OR (encrypted AND CASE WHEN version = 'TLS1.3'
                 THEN group_tier IN {RISK} AND key_group IS NOT NULL AND group_class <> 'UNKNOWN'
                 ELSE cipher_tier IN {RISK} AND cipher_known END) AS seen FROM e)"""
WEIGHT = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END"
RAW = f"coalesce(sum({WEIGHT} * confidence * (1 + least(1, log10(greatest(1, affected)) / 2))) FILTER (WHERE tier IN {RISK}), 0)"
FLOOR = f"coalesce(max(CASE WHEN affected >= 50 THEN 90 WHEN affected >= 45 THEN 80 ELSE 0 END) FILTER (WHERE tier IN {RISK}), 0)"
NORMAL = "CAST(round_even(100 * raw / (raw + 100), 0) AS INTEGER)"


def floor():
    return F.when(F.col("affected") >= 50, 90).when(F.col("affected") >= 45, 80).otherwise(0)


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def agg_14(spark, d):
    return _round(scoring.session_risk(findings(spark, d), "session").select("session", "raw_risk"), "raw_risk")


def agg_15(spark, d):
    return scoring.session_risk(findings(spark, d), "session", floor()).select("session", "observed_risk")


def agg_16(spark, d):
    return scoring.coverage(findings(spark, d), "session")


def agg_16_capture(spark, d):
    return scoring.coverage(findings(spark, d), empty=(0, 0, 0))


def agg_18(spark, d):
    return scoring.harvest_exposure(sessions(spark, d))


def agg_18_server(spark, d):
    return scoring.harvest_exposure(sessions(spark, d), "server")


def mth_03(spark, d):
    tiers = findings(spark, d).groupBy("session").agg(F.max("tier").alias("a"), F.min("tier").alias("b"))
    return tiers.select("session", f.weakest(F.col("a"), F.col("b")).alias("weakest"))


def flt_17(spark, d):
    rows = findings(spark, d).where("severity = 'critical'")
    empty = F.col("affected") % 3 == 0
    rows = rows.withColumn("evidence", F.when(empty, F.array().cast("array<int>")).otherwise(F.array("line"))).withColumn("reason", F.lit(None).cast("string"))
    return scoring.guarded(rows).groupBy("tier", "reason").agg(F.count("*").alias("n"))


def flt_17_first(spark, d):
    rows = findings(spark, d).select("session", "tier", "line", "affected", "confidence", "seen_at")
    first = scoring.first_of_each(rows, ["session", "tier"], ["line", "seen_at", "affected", "confidence"])
    return first.select("session", "tier", "line", "affected")


def srt_05(spark, d):
    """Fix first: the ten findings to fix first, by severity, then effort, then session."""
    rows = findings(spark, d).select("session", "severity", "affected", "line", "confidence", "seen_at").withColumn("rank", f.rank(F.col("severity"), list(f.WEIGHTS)))
    order = ["rank", "affected", "session", "line", "confidence", "seen_at"]
    return rows.orderBy(*order).limit(10).select("session", "severity", "affected", "line")


QUERIES = {
    "agg_11": lambda s, d: scoring.severity_counts(findings(s, d)),
    "agg_12": lambda s, d: scoring.transport_counts(sessions(s, d)),
    "agg_14": agg_14,
    "agg_15": agg_15,
    "agg_16": agg_16,
    "agg_16_capture": agg_16_capture,
    "agg_18": agg_18,
    "agg_18_server": agg_18_server,
    "agg_21": lambda s, d: scoring.worst_severity(findings(s, d), "session"),
    "agg_31": lambda s, d: findings(s, d).groupBy("severity").agg(F.round(1000 * F.avg((F.col("confidence") >= 0.95).cast("int")), 6).alias("alerts")),
    "flt_10": lambda s, d: sessions(s, d).where(scoring.established("protocol_tier", "version_tier")).select("session"),
    "flt_11": lambda s, d: sessions(s, d).where(scoring.is_encrypted()).select("session"),
    "flt_12": lambda s, d: sessions(s, d).where(scoring.is_cleartext()).select("session"),
    "flt_13": lambda s, d: sessions(s, d).select("session", scoring.key_exchange_observable().alias("observable"), scoring.quantum_safe().alias("safe")),
    "flt_14": lambda s, d: findings(s, d).groupBy(f.required_tier(F.col("tier")).alias("tier")).agg(F.count("*").alias("n")),
    "flt_15": lambda s, d: findings(s, d).groupBy("session", f.bucket(F.col("tier")).alias("bucket")).agg(F.count("*").alias("n")),
    "flt_16": lambda s, d: findings(s, d).where(F.col("adequate") & F.col("tier").isin(*f.RISK_TIERS)).groupBy("session").agg(F.count("*").alias("n")),
    "flt_17": flt_17,
    "flt_17_first": flt_17_first,
    "flt_18": lambda s, d: sessions(s, d).select("session").join(findings(s, d).where(f.rank(F.col("severity"), list(f.WEIGHTS)) <= 2).select("session"), "session", "left_anti"),
    "flt_20": lambda s, d: scoring.worst_severity(findings(s, d), "session").join(sessions(s, d).where("verdict = 'failed'").select("session"), "session", "left_semi").where("worst = 'high'"),
    "mth_02": lambda s, d: findings(s, d).groupBy("severity", f.escalated(F.col("severity")).alias("escalated")).agg(F.count("*").alias("n")),
    "mth_03": mth_03,
    "mth_10": lambda s, d: findings(s, d).groupBy("affected").agg(F.round(F.max(f.exposure(F.col("affected"))), 9).alias("exposure")),
    "prj_08": lambda s, d: agg_15(s, d).select("session", f.risk_band(F.col("observed_risk")).alias("band")),
    "set_10": lambda s, d: scoring.coverage(findings(s, d), "server"),
    "srt_05": srt_05,
}
SHARES = ", ".join(
    f"coalesce(CAST(round_even(100 * (count(*) FILTER (WHERE adequate AND tier = '{t}')) / nullif(count(*), 0), 0) AS INTEGER), 0) AS {n}"
    for t, n in (("OBSERVED", "evidence_coverage"), ("DEDUCED", "deduced_coverage"), ("INFERRED", "inferred_coverage"))
).replace("100 *", "100::DOUBLE *")
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
NAMES = "['critical', 'high', 'medium', 'low', 'info']"
HARVEST = """count(*) FILTER (WHERE seen AND NOT safe) AS exposed_sessions, count(*) FILTER (WHERE seen AND safe) AS quantum_safe_sessions,
    count(*) FILTER (WHERE seen) AS total_sessions, count(*) FILTER (WHERE NOT seen) AS unobservable_sessions,
    coalesce(CAST(round_even(100::DOUBLE * (count(*) FILTER (WHERE seen AND NOT safe)) / nullif(count(*) FILTER (WHERE seen), 0), 0) AS INTEGER), 0) AS percent"""
RISKS = f"{FACTS}, r AS (SELECT session, {RAW} AS raw, {FLOOR} AS fl FROM f GROUP BY session), k AS (SELECT session, greatest({NORMAL}, fl) AS observed_risk FROM r)"
ORACLES = {
    "agg_11": f"{FACTS} SELECT severity, count(*) AS n FROM f GROUP BY severity",
    "agg_12": f"{SESS} SELECT count(*) FILTER (WHERE encrypted) AS encrypted, count(*) FILTER (WHERE cleartext) AS cleartext, count(*) FILTER (WHERE NOT encrypted AND NOT cleartext) AS not_observable FROM e",
    "agg_14": f"{FACTS} SELECT session, round({RAW}, 6) AS raw_risk FROM f GROUP BY session",
    "agg_15": f"{RISKS} SELECT * FROM k",
    "agg_16": f"{FACTS} SELECT session, {SHARES} FROM f GROUP BY session",
    "agg_16_capture": f"{FACTS} SELECT {SHARES} FROM f",
    "agg_18": f"{SESS} SELECT {HARVEST} FROM o",
    "agg_18_server": f"{SESS} SELECT server, {HARVEST} FROM o GROUP BY server",
    "agg_21": f"{FACTS} SELECT session, {NAMES}[min({RANK}) + 1] AS worst FROM f GROUP BY session",
    "agg_31": f"{FACTS} SELECT severity, round(1000 * avg(CAST(confidence >= 0.95 AS INTEGER)), 6) AS alerts FROM f GROUP BY severity",
    "flt_10": f"{SESS} SELECT session FROM s WHERE protocol_tier IN {RISK} AND version_tier IN {RISK}",
    "flt_11": f"{SESS} SELECT session FROM e WHERE encrypted",
    "flt_12": f"{SESS} SELECT session FROM e WHERE cleartext",
    "flt_13": f"{SESS} SELECT session, encrypted AND seen AS observable, safe FROM o",
    "flt_14": f"{FACTS} SELECT tier, count(*) AS n FROM f GROUP BY tier",
    "flt_15": f"{FACTS} SELECT session, CASE WHEN tier IN {RISK} THEN 'risk' ELSE 'inferred' END AS bucket, count(*) AS n FROM f GROUP BY ALL",
    "flt_16": f"{FACTS} SELECT session, count(*) AS n FROM f WHERE adequate AND tier IN {RISK} GROUP BY session",
    "flt_17": f"""{FACTS}, g AS (SELECT *, tier IN {RISK} AND affected % 3 = 0 AS bare FROM f WHERE severity = 'critical')
        SELECT CASE WHEN bare THEN 'NOT_OBSERVABLE' ELSE tier END AS tier, CASE WHEN bare THEN 'not_present_in_capture' END AS reason, count(*) AS n FROM g GROUP BY ALL""",
    "flt_17_first": f"""{FACTS}, g AS (SELECT *, row_number() OVER (PARTITION BY session, tier ORDER BY line, seen_at, affected, confidence) AS n FROM f)
        SELECT session, tier, line, affected FROM g WHERE n = 1""",
    "flt_18": f"{FACTS} SELECT o_orderkey AS session FROM orders WHERE o_orderkey NOT IN (SELECT session FROM f WHERE severity IN ('critical', 'high', 'medium'))",
    "flt_20": f"{SESS}, f AS ({FINDINGS_SQL}) SELECT session, {NAMES}[min({RANK}) + 1] AS worst FROM f WHERE session IN (SELECT session FROM s WHERE verdict = 'failed') GROUP BY session HAVING min({RANK}) = 1",
    "mth_02": f"{FACTS} SELECT severity, {NAMES}[greatest(0, {RANK} - 1) + 1] AS escalated, count(*) AS n FROM f GROUP BY ALL",
    "mth_03": f"{FACTS} SELECT session, CASE WHEN bool_or(tier = 'INFERRED') THEN 'INFERRED' WHEN bool_or(tier = 'DEDUCED') THEN 'DEDUCED' ELSE 'OBSERVED' END AS weakest FROM (SELECT session, max(tier) AS tier FROM f GROUP BY session UNION ALL SELECT session, min(tier) FROM f GROUP BY session) GROUP BY session",
    "mth_10": f"{FACTS} SELECT DISTINCT affected, round(1 + least(1, log10(greatest(1, affected)) / 2), 9) AS exposure FROM f",
    "prj_08": f"{RISKS} SELECT session, CASE WHEN observed_risk >= 85 THEN 'critical' WHEN observed_risk >= 50 THEN 'high' WHEN observed_risk >= 15 THEN 'medium' ELSE 'low' END AS band FROM k",
    "set_10": f"{FACTS} SELECT server, {SHARES} FROM f GROUP BY server",
    "srt_05": f"{FACTS} SELECT session, severity, affected, line FROM f ORDER BY {RANK}, affected, session, line, confidence, seen_at LIMIT 10",
}
