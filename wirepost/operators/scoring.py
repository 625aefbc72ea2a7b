"""Risk, coverage and exposure scores over tiered facts and findings. Tables are narrow; every score is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as f


def session_risk(findings: DataFrame, by: str, floor: Column | None = None) -> DataFrame:
    """(by, raw_risk, observed_risk) of findings (by, severity, confidence, affected, tier): only risk tiers count.

    raw_risk sums weight, confidence and exposure; observed_risk is the normalised one, at least the largest `floor`.
    Sessions without a finding that counts have zero risk.
    """
    counts = F.col("tier").isin(*f.RISK_TIERS)
    part = f.lookup(F.col("severity"), f.WEIGHTS, 0) * F.col("confidence") * f.exposure(F.col("affected"))
    least = F.lit(0) if floor is None else F.coalesce(F.max(F.when(counts, floor)), F.lit(0))
    raw = F.coalesce(F.sum(F.when(counts, part)), F.lit(0.0))
    table = findings.groupBy(by).agg(raw.alias("raw_risk"), least.alias("floor"))
    return table.select(by, "raw_risk", F.greatest(f.normalized_risk(F.col("raw_risk")), F.col("floor")).alias("observed_risk"))


def coverage(facts: DataFrame, *by: str, empty: tuple[int, int, int] = (100, 0, 0)) -> DataFrame:
    """Percent of facts (tier, adequate) that are adequate and observed, deduced, inferred; pooled over `by`, never averaged."""
    shares = [f.percent(F.count_if(F.col("adequate") & (F.col("tier") == t)), F.count("*"), e).alias(n) for t, n, e in zip(f.TIERS, ("evidence_coverage", "deduced_coverage", "inferred_coverage"), empty, strict=False)]
    return facts.groupBy(*by).agg(*shares)


def established(*tiers: str) -> Column:
    """All of the facts' tiers may affect risk."""
    out = F.lit(True)
    for t in tiers:
        out = out & f.false_if_null(F.col(t).isin(*f.RISK_TIERS))
    return out


def is_encrypted() -> Column:
    return F.col("version").isNotNull() & established("version_tier")


def is_cleartext() -> Column:
    mail = f.false_if_null(F.col("protocol").isin(*f.MAIL_PROTOCOLS)) & established("protocol_tier")
    not_failed = f.false_if_null(F.col("verdict") != "failed") | F.col("verdict").isNull() | established("verdict_tier")
    return mail & F.col("version").isNull() & ~f.false_if_null(F.col("verdict") == "upgraded") & not_failed


def key_exchange_observable() -> Column:
    new = established("group_tier") & F.col("key_group").isNotNull() & ~f.false_if_null(F.col("group_class") == "UNKNOWN")
    old = established("cipher_tier") & f.false_if_null(F.col("cipher_known"))
    return is_encrypted() & F.when(F.col("version") == "TLS1.3", new).otherwise(old)


def quantum_safe() -> Column:
    return f.false_if_null(F.col("hybrid")) & established("hybrid_tier") & F.col("key_group").isNotNull() & ~f.false_if_null(F.col("group_class") == "UNKNOWN")


def transport_counts(sessions: DataFrame) -> DataFrame:
    """One row: encrypted, cleartext and all other sessions, which are disjoint."""
    return sessions.agg(
        F.count_if(is_encrypted()).alias("encrypted"),
        F.count_if(is_cleartext()).alias("cleartext"),
        F.count_if(~is_encrypted() & ~is_cleartext()).alias("not_observable"),
    )


def harvest_exposure(sessions: DataFrame, *by: str) -> DataFrame:
    """Sessions whose recorded traffic could be decrypted later: exposed and safe ones among those observable, the rest apart."""
    seen = is_cleartext() | key_exchange_observable()
    counts = sessions.groupBy(*by).agg(
        F.count_if(seen & ~quantum_safe()).alias("exposed_sessions"),
        F.count_if(seen & quantum_safe()).alias("quantum_safe_sessions"),
        F.count_if(seen).alias("total_sessions"),
        F.count_if(~seen).alias("unobservable_sessions"),
    )
    return counts.withColumn("percent", f.percent(F.col("exposed_sessions"), F.col("total_sessions")))


def guarded(findings: DataFrame) -> DataFrame:
    """findings (tier, evidence array, reason) with the evidence guard: a risk tier without evidence is NOT_OBSERVABLE, with a reason."""
    bare = F.col("tier").isin(*f.RISK_TIERS) & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)
    return findings.withColumns({"tier": F.when(bare, "NOT_OBSERVABLE").otherwise(F.col("tier")), "reason": F.when(bare, "not_present_in_capture").otherwise(F.col("reason"))})


def first_of_each(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of findings with equal keys the one first emitted."""
    columns = [c for c in findings.columns if c not in keys]
    best = findings.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def worst_severity(findings: DataFrame, by: str) -> DataFrame:
    order = list(f.WEIGHTS)
    worst = findings.groupBy(by).agg(F.min(f.rank(F.col("severity"), order)).alias("rank"))
    return worst.select(by, f.lookup(F.col("rank"), dict(enumerate(order))).alias("worst"))
