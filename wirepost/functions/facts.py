"""Closed vocabularies and the column functions over tiered facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence tiers from strongest to weakest; the first two may affect risk.
TIERS = ("OBSERVED", "DEDUCED", "INFERRED", "NOT_OBSERVABLE")
RISK_TIERS = ("OBSERVED", "DEDUCED")
#: Severities from worst to mildest, with their weights.
WEIGHTS = {"critical": 40, "high": 20, "medium": 8, "low": 3, "info": 0}
#: Versions whose use alone sets a risk floor.
DEPRECATED_VERSIONS = ("SSL3.0", "TLS1.0", "TLS1.1")
MAIL_PROTOCOLS = ("smtp", "imap", "pop3")


def sql_literal(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "\\'") + "'"


def lookup(column: Column, table: dict, default=None) -> Column:
    """table[column], default for other values. Large tables of code points become one map."""
    if len(table) > 8 and all(isinstance(k, int) for k in table):
        entries = ", ".join(f"{k}, {sql_literal(v)}" for k, v in table.items())
        found = F.try_element_at(F.expr(f"map({entries})"), column.cast("int"))
        return found if default is None else F.coalesce(found, F.lit(default))
    out = F.lit(default)
    for key, value in reversed(table.items()):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def rank(column: Column, order: Sequence[str]) -> Column:
    """Place of a value in a closed vocabulary, from 0; len(order) for others."""
    return lookup(column, {v: i for i, v in enumerate(order)}, len(order))


def required_tier(tier: Column) -> Column:
    """The tier itself; a null or unknown one fails the query."""
    message = F.concat(F.lit("untiered fact: "), F.coalesce(tier, F.lit("null")))
    return F.when(tier.isin(*TIERS), tier).otherwise(F.raise_error(message))


def weakest(*tiers: Column) -> Column:
    """The weakest of some tiers; nulls count as the weakest there is."""
    worst = F.greatest(F.lit(0), *(F.coalesce(rank(t, TIERS), F.lit(len(TIERS) - 1)) for t in tiers))
    return lookup(worst, dict(enumerate(TIERS)))


def bucket(tier: Column) -> Column:
    """risk, inferred or coverage: what a fact of this tier may affect."""
    return F.when(tier.isin(*RISK_TIERS), "risk").when(tier == "INFERRED", "inferred").otherwise("coverage")


def exposure(sessions: Column) -> Column:
    return F.lit(1.0) + F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), sessions).cast("double")) / 2)


def normalized_risk(raw: Column) -> Column:
    """round(100 raw / (raw + 100)), half to even."""
    return F.bround(raw * 100 / (raw + 100), 0).cast("int")


def percent(part: Column, whole: Column, empty: int = 0) -> Column:
    """Share in percent, half to even; `empty` where there is nothing to share."""
    share = F.bround(part.cast("double") * 100 / F.when(whole > 0, whole).cast("double"), 0)
    return F.coalesce(share.cast("int"), F.lit(empty))


def risk_band(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 50, "high").when(score >= 15, "medium").otherwise("low")


def escalated(severity: Column) -> Column:
    """One step worse, at most critical."""
    order = list(WEIGHTS)
    return lookup(severity, {s: order[max(0, i - 1)] for i, s in enumerate(order)})


def false_if_null(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))
