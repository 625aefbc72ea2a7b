"""Facts of sessions to findings: rules as data, reasons for what can't be seen, texts, order of work, associations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, mail
from ..functions.conditions import condition
from ..tables import stage

#: Why a fact can't be observed.
REASONS = ("tls13_encrypted_certificate", "midstream_capture", "ech_enabled", "not_present_in_capture", "unsupported_link_type", "malformed_certificate", "unsupported_algorithm")
#: Confidence of a finding by its band, and kinds of work from least to most.
BANDS = {"certain": 1.0, "inferred": 0.75, "anomaly": 0.5}
EFFORTS = ("one_line_reload", "cert_reissue", "software_upgrade")


def met_rules(sessions: DataFrame, rules: dict[str, str], evidence: Column | None = None) -> DataFrame:
    """sessions with rule: a row for each rule (id -> condition) that a session meets and, if asked for, has evidence for (an array that isn't empty)."""
    proven = F.lit(True) if evidence is None else F.coalesce(F.size(evidence) > 0, F.lit(False))
    found = F.array_compact(F.array(*(F.when(condition(text, sessions.schema) & proven, rule) for rule, text in rules.items())))
    return sessions.select("*", F.explode(found).alias("rule"))


def reason_codes(tiers: Column, reasons: Column, midstream: Column) -> Column:
    """The reasons (map) of facts whose tier (map) is NOT_OBSERVABLE; all the same in a session met midstream. A missing or unknown one fails the query."""
    told = F.when(midstream, F.transform_values(reasons, lambda k, v: F.lit("midstream_capture"))).otherwise(reasons)
    hidden = F.map_filter(tiers, lambda k, t: t == "NOT_OBSERVABLE")
    known = lambda k: F.try_element_at(told, k).isin(*REASONS)
    wrong = lambda k: F.raise_error(F.concat(F.lit("no known reason for "), k)).cast("string")
    return F.transform_values(hidden, lambda k, t: F.when(F.coalesce(known(k), F.lit(False)), F.try_element_at(told, k)).otherwise(wrong(k)))


def finding(rule: Column, text: Column, group: Column, band: Column, own_tier: Column, tiers: Column, confidence: Column, remediation: Column) -> Column:
    """struct(what, tier, confidence, remediation): the rule's text with the group's name, no surer than the weakest of the facts it rests on."""
    named = F.replace(text, F.lit("{group}"), F.coalesce(group, F.lit("unidentified group")))
    ranks = F.transform(tiers, lambda t: facts.rank(facts.required_tier(t), facts.TIERS))
    worst = F.greatest(F.array_max(ranks), facts.rank(own_tier, facts.TIERS))
    return F.struct(
        named.alias("what"),
        facts.lookup(worst, dict(enumerate(facts.TIERS))).alias("tier"),
        F.coalesce(confidence, facts.lookup(band, BANDS)).alias("confidence"),
        F.coalesce(remediation, F.replace(F.lower(rule), F.lit("-"), F.lit("_"))).alias("remediation"),
    )


def fact_rows(sessions: DataFrame, by: str, applicable: dict[str, Column]) -> DataFrame:
    """(by, fact, tier): the facts of a session that apply to it; their tiers are columns tier_<fact>."""
    rows = F.array_compact(F.array(*(F.when(facts.false_if_null(when), F.struct(F.lit(n).alias("fact"), facts.required_tier(F.col(f"tier_{n}")).alias("tier"))) for n, when in applicable.items())))
    return sessions.select(by, F.explode(rows).alias("f")).select(by, "f.*")


def by_effort(findings: DataFrame, by: str, effort: str, place: str) -> DataFrame:
    """(by, places): the places of a group's findings, each once, from least work to most; equal ones, and then unknown ones, in their own order."""
    order = F.struct(facts.rank(F.col(effort), EFFORTS).alias("r"), F.col(place).alias("p"))
    return findings.groupBy(by).agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["p"]).alias("places"))


def establishing(evidence: DataFrame, by: str) -> DataFrame:
    """(by, evidence): distinct places (session, frame, offset, kind) in order; sessions sort as text."""
    place = F.struct(F.col("session").cast("string").alias("session"), "frame", "offset", "kind")
    return evidence.groupBy(by).agg(F.array_sort(F.collect_set(place)).alias("evidence"))


def associated(sessions: DataFrame, newest_only: bool = True) -> DataFrame:
    """(session, server, fingerprints, ambiguous): certificates that other sessions of the same server showed to those that hide theirs.

    sessions: (session, server, version, status, fingerprint). Only TLS 1.3 sessions whose certificate can't be observed get
    any (with `newest_only` off, all whose certificate can't be observed); it is context, and more than one makes it ambiguous. A server's certificates are few: they are gathered before any
    session meets them.
    """
    shown = sessions.where((F.col("status") != "NOT_OBSERVABLE") & F.col("fingerprint").isNotNull())
    known = shown.groupBy("server").agg(F.sort_array(F.collect_set("fingerprint")).alias("fingerprints"))
    aimed = (F.col("version") == "TLS1.3") if newest_only else F.lit(True)
    hidden = sessions.where(aimed & (F.col("status") == "NOT_OBSERVABLE")).select("session", "server")
    return hidden.join(known, "server").select("session", "server", "fingerprints", (F.size("fingerprints") > 1).alias("ambiguous"))


def inconsistent_sessions(contradictions: DataFrame, cells: DataFrame) -> DataFrame:
    """(server, session, capability, shown, excluded): sessions on either side of a contradiction, with how many of the server's sessions are on each.

    contradictions: (server, capability); cells: (server, capability, session, sign), 1 for shown and -1 for excluded.
    """
    torn = contradictions.select(F.col("server").alias("server_"), F.col("capability").alias("capability_"))
    met = cells.where("sign <> 0").join(torn, (F.col("server") == F.col("server_")) & (F.col("capability") == F.col("capability_")))
    # written once, as it is read twice and all observations stand behind it; a row for each session
    up, down = F.max((F.col("sign") > 0).cast("int")), F.max((F.col("sign") < 0).cast("int"))
    sides = stage(met.groupBy("server", "capability", "session").agg(up.alias("up"), down.alias("down")), "sides")
    counts = sides.groupBy(F.col("server").alias("server_"), F.col("capability").alias("capability_")).agg(F.sum("up").alias("shown"), F.sum("down").alias("excluded"))
    both = sides.join(counts, (F.col("server") == F.col("server_")) & (F.col("capability") == F.col("capability_")))
    return both.select("server", "session", "capability", "shown", "excluded")


def pop3_grammar_lines(lines: DataFrame) -> DataFrame:
    """Lines (flow, dir, at, line) of the server without the message bodies that it sends.

    The first server line after a RETR is its status; a positive one begins a body, which the next line of a single dot ends.
    """
    rows = lines.withColumn("up", mail.upper_ascii(F.col("line")))
    order = Window.partitionBy("flow").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    server = F.col("dir") == "s2c"
    asked = F.last(F.when(~server, F.when(F.col("up").rlike(r"^RETR([ \t]|\r?\n)"), F.lit(True))).otherwise(False), ignorenulls=True).over(before)
    rows = rows.withColumn("status", server & F.coalesce(asked, F.lit(False)))
    edge = F.when(F.col("status") & F.col("up").startswith("+OK"), True).when(server & ~F.col("status") & F.col("line").isin(".\r\n", ".\n"), False)
    rows = rows.withColumn("inside", F.coalesce(F.last(edge, ignorenulls=True).over(before), F.lit(False)))
    return rows.where(server & (F.col("status") | ~F.col("inside"))).select(*lines.columns)


def message_bodies(payloads: DataFrame) -> DataFrame:
    """payloads (flow, dir, at, line) with body: whether a client's payload is part of an SMTP message.

    DATA begins one, a payload that ends in a line of a single dot closes it. A payload that does both turns the state over.
    """
    client = F.col("dir") == "c2s"
    starts = client & mail.upper_ascii(F.col("line")).rlike(r"^DATA([ \t]|\r?\n)")
    ends = client & F.col("line").rlike(r"\n\.\r?\n$")
    before = Window.partitionBy("flow").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    set_ = F.when(starts & ~ends, True).when(ends & ~starts, False)
    rows = payloads.withColumns({"sets": F.coalesce(F.count(set_).over(before), F.lit(0)), "state": F.coalesce(F.last(set_, ignorenulls=True).over(before), F.lit(False)), "turns": (starts & ends).cast("int")})
    since = Window.partitionBy("flow", "sets").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum("turns").over(since), F.lit(0)) % 2 == 1
    return rows.select(*payloads.columns, (client & (F.col("state") != turned)).alias("body"))


#: What a TLS handshake message is called, by its type. The texts that frame_summaries() gives are fixed too, as
#: others show them.
HANDSHAKES = {1: "ClientHello", 2: "ServerHello", 11: "Certificate"}


def frame_summaries(payloads: DataFrame) -> DataFrame:
    """message_bodies() rows (also kind, the flow's protocol) with summary and layer: what a frame is, never what it says."""
    line, kind, size = F.col("line"), F.col("kind"), F.length("line").cast("string")
    up, side = mail.upper_ascii(line), F.when(F.col("dir") == "c2s", "C").otherwise("S")
    named = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    hidden = named("C: [message body, ", size, " bytes, not displayed]")
    says = lambda word: (kind == "smtp") & up.rlike(rf"^{word}([ \t]|\r?\n)")
    known = reduce(lambda c, item: c.when(F.ascii(F.substring(line, 6, 1)) == item[0], item[1]), HANDSHAKES.items(), F.when(F.lit(False), ""))
    tls = F.when(F.substring(line, 1, 1) == "\x16", named(side, ": TLS ", F.coalesce(known, F.lit("handshake")))).when(F.substring(line, 1, 1) == "\x17", named("TLS Application Data (", size, " bytes)")).otherwise(named(side, ": TLS record"))
    code = F.regexp_extract(line, r"^(\d{3})", 1)
    client = (
        F.when(F.col("body") | says("BDAT"), hidden)
        .when(mail.is_auth(line, kind), "C: AUTH [REDACTED]")
        .when(says("DATA"), "C: DATA")
        .when(says("EHLO"), "C: EHLO")
        .when(says("STARTTLS"), "C: STARTTLS")
        .otherwise(named("C: [", kind, " data, ", size, " bytes, not displayed]"))
    )
    server = (
        F.when(kind == "smtp", F.when(code != "", named("S: ", code, " SMTP response")).otherwise("S: [protocol data, not displayed]"))
        .when(kind.isin("imap", "pop3"), named("S: ", F.upper(kind), " response"))
        .otherwise(named("TCP segment (", size, " bytes)"))
    )
    is_tls = line.rlike("^[\x14-\x17]\x03") & (F.length("line") >= 5)
    layer = F.when(is_tls, "tls").when((F.col("dir") == "s2c") & ~kind.isin("smtp", "imap", "pop3"), "tcp").otherwise(kind)
    return payloads.select("*", F.when(is_tls, tls).when(F.col("dir") == "c2s", client).otherwise(server).alias("summary"), layer.alias("layer"))


def roles(heads: DataFrame) -> DataFrame:
    """(flow, kind, swapped) of flows' first lines (flow, client_line, server_line): sides are swapped where only the supposed client greets as a server does."""
    none = F.lit(None).cast("string")
    as_is = mail.protocol(F.col("server_line"), F.col("client_line"))
    turned = mail.protocol(F.col("client_line"), none)
    swapped = mail.protocol(F.col("server_line"), none).isNull() & turned.isNotNull()
    return heads.select("flow", F.when(swapped, turned).otherwise(as_is).alias("kind"), swapped.alias("swapped"))


def facts_for_rules(version: Column, secrecy: Column, ocsp: Column, answered: Column) -> Column:
    """struct(forward_secrecy, ocsp_stapling) as rules may read them: secrecy is known under TLS 1.3 only, stapling only where the server answered."""
    return F.struct(
        F.when(version == "TLS1.3", secrecy).otherwise("UNKNOWN").alias("forward_secrecy"),
        F.when(facts.false_if_null(answered), ocsp).otherwise("not_observable").alias("ocsp_stapling"),
    )


def judged(expected: DataFrame, actual: DataFrame, by: str, *names: str) -> DataFrame:
    """(by, fact, wanted, found): facts (as text) that a session should have and has otherwise, or lacks with the whole session."""
    rows = lambda t, n: F.array(*(F.struct(F.lit(c).alias("fact"), F.col(c).cast("string").alias(n)) for c in names))
    want = expected.select(by, F.explode(rows(expected, "wanted")).alias("w")).select(by, "w.*")
    have = actual.select(by, F.explode(rows(actual, "found")).alias("h")).select(F.col(by).alias("by2"), F.col("h.fact").alias("fact2"), "h.found")
    met = want.join(have, (F.col(by) == F.col("by2")) & (F.col("fact") == F.col("fact2")), "left")
    return met.where(F.col("by2").isNull() | ~F.col("wanted").eqNullSafe(F.col("found"))).select(by, "fact", "wanted", "found")
