"""Queries of rules, findings, reports and message bytes, over sessions and lines projected from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions, facts, tls
from ..operators import certificates, correlation, findings, forest, handshakes, inventory, lines, reports
from . import bridge, verdicts
from . import correlation as correlation_plans
from .bridge import OFFERS_SQL, SESSIONS_SQL, table
from .scoring import SESS
from .text import _SQL_SAMPLES, SAMPLES

S = f"WITH s AS ({SESSIONS_SQL})"
#: Rules that the queries apply, with what they mean in SQL.
RULES = {
    "newest": ("tls.version == TLS1.3", "version = 'TLS1.3'"),
    "not_1.2": ("tls.version != 'TLS1.2'", "version <> 'TLS1.2'"),
    "high": ("tls.score >= 0x32", "score >= 50"),
    "hybrid": ("tls.hybrid == true", "hybrid"),
    "no_group": ("tls.group is null", "key_group IS NULL"),
    "some_group": ("tls.group is not empty", "key_group <> ''"),
    "nowhere": ("tls.nothing == 1", "false"),
    "text_against_number": ("tls.score < abc", "false"),
    "other_kind": ("tls.score != abc", "true"),
    "small": ("tls.share <= 1.5", "share <= 1.5"),
}
LITERALS = ("true", "NULL", "0x1F", "-12", "3.5", "1e5", "abc", "12a", "+7", ".5", "None", "0xZZ", "", "FALSE", "1_000", "-.5e-3")


def pick(key, n, *values):
    return F.element_at(F.array(*map(F.lit, values)), (key % n % len(values) + 1).cast("int"))


def sql_pick(n, *values):
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][session % {n} % {len(values)} + 1]"


def ruled(s, d):
    share = (F.col("session") % 7).cast("double") / 2
    tls_ = F.struct("version", F.col("key_group").alias("group"), "hybrid", (F.col("session") % 100).cast("int").alias("score"), share.alias("share"))
    return bridge.sessions(s, d).select("session", tls_.alias("tls"))


def flt_07(s, d):
    return findings.met_rules(ruled(s, d), {r: text for r, (text, _) in RULES.items()}).select("session", "rule")


def jon_12(s, d):
    proof = F.when(F.col("session") % 3 > 0, F.array("session"))
    return findings.met_rules(ruled(s, d), {r: text for r, (text, _) in RULES.items()}, proof).select("session", "rule")


def sql_rules(where):
    rows = f"{S}, r AS (SELECT *, session % 100 AS score, session % 7 / 2.0 AS share FROM s WHERE {where})"
    return rows + " UNION ALL ".join(f" SELECT session, '{r}' AS rule FROM r WHERE {sql}" for r, (_, sql) in RULES.items())


def flt_08(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("session"), conditions.kind_of(pick(k, 10**9, *LITERALS)).alias("kind"))


def flt_09(s, d):
    rows = table(s, d, "events")
    return rows.select("event_id", *(conditions.json_at(F.col("props"), p).alias(n) for n, p in (("found", "k"), ("beyond", "k.x"), ("missing", "none"))))


def reasons(s, d, midstream):
    k = F.col("session")
    tiers = F.create_map(F.lit("version"), pick(k, 3, "OBSERVED", "NOT_OBSERVABLE"), F.lit("certificate"), pick(k, 5, "NOT_OBSERVABLE", "DEDUCED"), F.lit("group"), pick(k, 7, "INFERRED", "NOT_OBSERVABLE"))
    why = F.create_map(F.lit("version"), pick(k, 11, "ech_enabled", "not_present_in_capture"), F.lit("certificate"), F.lit("malformed_certificate"), F.lit("group"), F.lit("unsupported_algorithm"))
    return bridge.sessions(s, d).select("session", F.explode(findings.reason_codes(tiers, why, midstream)).alias("fact", "reason"))


def sql_reasons(midstream):
    parts = (("version", sql_pick(3, "OBSERVED", "NOT_OBSERVABLE"), sql_pick(11, "ech_enabled", "not_present_in_capture")), ("certificate", sql_pick(5, "NOT_OBSERVABLE", "DEDUCED"), "'malformed_certificate'"), ("group", sql_pick(7, "INFERRED", "NOT_OBSERVABLE"), "'unsupported_algorithm'"))
    return S + " UNION ALL ".join(f" SELECT session, '{n}' AS fact, CASE WHEN {midstream} THEN 'midstream_capture' ELSE {why} END AS reason FROM s WHERE {tier} = 'NOT_OBSERVABLE'" for n, tier, why in parts)


def prj_06(s, d):
    k = F.col("session")
    made = findings.finding(
        F.lit("PQ-HYBRID-OBSERVED"), F.lit("Key exchange {group} was selected"), F.col("key_group"), pick(k, 6, "certain", "inferred", "anomaly"), F.lit("DEDUCED"),
        F.array("group_tier", "hybrid_tier"), F.when(k % 17 == 0, 0.42), F.when(k % 5 == 0, "own_id"),
    )
    return bridge.sessions(s, d).select("session", made.alias("f")).select("session", "f.*")


def prj_12(s, d):
    rows = bridge.sessions(s, d).withColumns({"tier_version": F.col("version_tier"), "tier_group": F.col("group_tier"), "tier_cipher": F.col("cipher_tier")})
    return findings.fact_rows(rows, "session", {"version": F.col("protocol") != "unknown", "group": F.col("version") == "TLS1.3", "cipher": F.col("version").isNotNull()})


def prj_13(s, d):
    rows = tls.with_signals(verdicts.negotiated(s, d).select("session", F.col("version").alias("v"), "client", "server", "types", F.col("number").alias("version"), F.col("cbc").alias("static_kex"), "offered", "sentinel"))
    return rows.select("session", findings.facts_for_rules(F.col("v"), F.col("forward_secrecy"), F.col("ocsp_stapling"), F.col("server").isNotNull()).alias("f")).select("session", "f.*")


def dom_17(s, d):
    rows = bridge.sessions(s, d).select("session", "version", "verdict", "hybrid")
    found = rows.where("session % 13 <> 0").withColumns({"version": F.when(F.col("session") % 17 == 0, "SSL3.0").otherwise(F.col("version")), "hybrid": F.col("hybrid") | (F.col("session") % 11 == 0)})
    return findings.judged(rows, found, "session", "version", "verdict", "hybrid")


def prj_02(s, d):
    rows = verdicts.flow_lines(s, d)
    head = lambda side: F.min_by(F.when(F.col("dir") == side, F.col("line")), F.when(F.col("dir") == side, F.col("at")))
    return findings.roles(rows.groupBy("flow").agg(head("c2s").alias("client_line"), head("s2c").alias("server_line")))


MAILBOX = (("c2s", "RETR 1\r\n"), ("s2c", "+OK 120 octets\r\n"), ("s2c", "+OK inside a body\r\n"), ("s2c", ".\r\n"), ("c2s", "NOOP\r\n"), ("s2c", "-ERR no\r\n"), ("c2s", "retr 2\n"), ("s2c", "body\r\n"), ("s2c", "..\r\n"))
MESSAGES = (("c2s", "DATA\r\n"), ("s2c", "354 go\r\n"), ("c2s", "some text\r\n"), ("c2s", "last\r\n.\r\n"), ("c2s", "DATA\r\n.\r\n"), ("c2s", "EHLO a\r\n"), ("s2c", "250 ok\r\n"), ("c2s", "AUTH PLAIN x\r\n"), ("c2s", "BDAT 4\r\n"), ("c2s", "\x16\x03\x01\x00\x05\x01\r\n"), ("s2c", "\x17\x03\x03\x00\x05"), ("s2c", "\x16\x03\x01\x00\x05\x02"), ("c2s", "STARTTLS\r\n"), ("s2c", "hm"))


def spoken(s, d, said):
    """orders as lines of their customers, by a remainder that jumps about."""
    k, n = F.col("o_orderkey"), len(said)
    at = ((k * 7 + F.floor(k / 5)) % n + 1).cast("int")
    side, line = (F.element_at(F.array(*(F.lit(x[i]) for x in said)), at) for i in (0, 1))
    kind = pick(F.col("o_custkey"), 10**9, "smtp", "smtp", "imap", "unknown")
    return table(s, d, "orders").select(F.col("o_custkey").alias("flow"), k.alias("at"), side.alias("dir"), line.alias("line"), kind.alias("kind"))


def sql_text(text):
    return "concat(" + ", ".join(f"chr({ord(c)})" if ord(c) < 32 else f"'{c}'" for c in text) + ")"


def sql_spoken(lines):
    n = len(lines)
    at = f"CAST((o_orderkey * 7 + o_orderkey // 5) % {n} + 1 AS INTEGER)"
    return f"""SELECT o_custkey AS flow, o_orderkey AS "at", [{', '.join(repr(x) for x, _ in lines)}][{at}] AS dir, [{', '.join(sql_text(x) for _, x in lines)}][{at}] AS line,
        ['smtp', 'smtp', 'imap', 'unknown'][o_custkey % 4 + 1] AS kind FROM orders"""


def win_07(s, d):
    return findings.pop3_grammar_lines(spoken(s, d, MAILBOX).select("flow", "at", "dir", "line")).select("flow", "at")


def win_08(s, d):
    return findings.message_bodies(spoken(s, d, MESSAGES)).select("flow", "at", "body")


def prj_09(s, d):
    return findings.frame_summaries(findings.message_bodies(spoken(s, d, MESSAGES))).select("flow", "at", "summary", "layer")


#: One state after another, by recursion: not how the operators do it.
STATE = """WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY "at") AS i FROM ({lines})),
    r AS (SELECT flow, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS dir, CAST(NULL AS VARCHAR) AS kind, false AS inside, false AS awaiting, false AS kept FROM l GROUP BY flow
        UNION ALL SELECT l.flow, l.i, l."at", l.line, l.dir, l.kind, {inside}, {awaiting}, {kept} FROM r JOIN l ON l.flow = r.flow AND l.i = r.i + 1)"""
WIN_07 = STATE.format(
    lines=sql_spoken(MAILBOX),
    inside="CASE WHEN l.dir = 'c2s' THEN inside WHEN awaiting THEN inside OR l.line LIKE '+OK%' WHEN l.line = concat('.', chr(13), chr(10)) THEN false ELSE inside END",
    awaiting="CASE WHEN l.dir = 'c2s' THEN awaiting OR lower(l.line) LIKE 'retr %' ELSE false END",
    kept="l.dir = 's2c' AND (awaiting OR NOT inside)",
)
WIN_08 = STATE.format(
    lines=sql_spoken(MESSAGES),
    inside="CASE WHEN l.dir = 's2c' THEN inside WHEN inside THEN NOT ends_with(l.line, concat(chr(10), '.', chr(13), chr(10))) ELSE starts_with(l.line, concat('DATA', chr(13))) END",
    awaiting="false",
    kept="l.dir = 'c2s' AND inside",
)


def srt_03(s, d):
    rows = bridge.findings(s, d).select("server", "session", F.col("line").alias("frame"), (F.col("affected") % 4).alias("offset"), F.col("severity").alias("kind"))
    return findings.establishing(rows, "server").select("server", F.transform("evidence", lambda e: F.concat_ws("/", e["session"], e["frame"].cast("string"), e["offset"].cast("string"), e["kind"])).alias("evidence"))


def srt_04(s, d):
    effort = pick(F.col("line"), 10**9, "software_upgrade", "one_line_reload", "cert_reissue", "unheard_of")
    return findings.by_effort(bridge.findings(s, d).withColumn("effort", effort), "session", "effort", "line")


def set_08(s, d):
    by = bridge.offers(s, d).groupBy("server").agg(*(F.collect_set(F.when(F.col("selected") == c, F.col("session"))).alias(n) for n, c in (("a", bridge.SUITE_A), ("b", bridge.SUITE_B))))
    return by.select("server", F.sort_array(F.array_union("a", "b")).alias("sessions"))


def jon_16(s, d, newest_only=True):
    k = F.col("session")
    status = pick(k, 5, "NOT_OBSERVABLE", "VALID")
    return findings.associated(bridge.sessions(s, d).select("session", "server", "version", status.alias("status"), F.when(k % 4 > 0, F.concat(F.lit("f"), (k % 3).cast("string"))).alias("fingerprint")), newest_only)


def dom_09(s, d):
    rows = bridge.offers(s, d)
    modes = correlation.preference_modes(rows)
    cells = correlation.observations(rows, modes)
    matrix = correlation.support_matrix(rows, modes).where("state = 'CONTRADICTED'").select("server", "capability")
    return findings.inconsistent_sessions(matrix, cells)


SUITES = {bridge.SUITE_A: (("ECDHE", "key-agree"), ("RSA", "signature"), ("AES-128-GCM", "ae"), ("SHA256", "hash")), bridge.SUITE_B: (("ECDHE", "key-agree"), ("RSA", "signature"), ("AES-256-GCM", "ae"), ("SHA384", "hash"))}


def used(s, d):
    parts = [F.when(F.col("selected") == c, F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("primitive")) for n, p in names))) for c, names in SUITES.items()]
    return bridge.offers(s, d).select("server", F.explode(F.coalesce(*parts)).alias("a")).select("server", "a.*")


USED = f"""WITH o AS ({OFFERS_SQL}), a AS (SELECT DISTINCT server, selected FROM o),
    m AS (SELECT * FROM (VALUES {', '.join(f"({c}, '{n}', '{p}', 'crypto/algorithm/{n}-{p}')" for c, names in SUITES.items() for n, p in names)}) v(code, name, primitive, ref)),
    i AS (SELECT DISTINCT server, lower(ref) AS ref, name, primitive FROM a JOIN m ON code = selected)"""


def snk_05(s, d):
    """Inventories of servers: what their matrix demonstrates, suites only with the version that one session chose with them."""
    rows = bridge.offers(s, d)
    matrix = correlation.support_matrix(rows, correlation.preference_modes(rows))
    protocols = inventory.with_parts(inventory.spoken(rows, matrix)).withColumn("by", F.col("server")).withColumn("server", F.col("server").cast("string"))
    groups = rows.where("session % 50 = 0").select(F.col("server").alias("by"), F.when(F.col("session") % 100 == 0, 0x11EC).otherwise(0x001D).alias("group_code")).distinct()
    return inventory.documents(protocols, groups, "by")


_SUITE = {c: [*(("ECDHE", "key-agree", None), ("RSA", "signature", None)), (f"AES-{n}-GCM", "ae", "gcm")] for c, n in ((bridge.SUITE_A, 128), (bridge.SUITE_B, 256))}
_NAMES = {bridge.SUITE_A: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", bridge.SUITE_B: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384"}


def _algorithm_json(name, primitive, mode=None, level=None):
    more = (f',"mode":"{mode}"' if mode else "") + (f',"nistQuantumSecurityLevel":{level}' if level is not None else "")
    return f'{{"bom-ref":"crypto/algorithm/{name}-{primitive}","cryptoProperties":{{"algorithmProperties":{{"cryptoFunctions":["unknown"],"executionEnvironment":"unknown"{more},"primitive":"{primitive}"}},"assetType":"algorithm"}},"name":"{name}","type":"cryptographic-asset"}}'


_SUITES_JSON = {c: f'{{"name":"{_NAMES[c]}","algorithms":[{",".join(chr(34) + f"crypto/algorithm/{n}-{p}" + chr(34) for n, p, _ in parts)}],"identifiers":["0xC0","0x{c & 255:02X}"]}}' for c, parts in _SUITE.items()}
_GROUPS_SQL = {0x11EC: ("X25519MLKEM768", "kem", 3), 0x001D: ("x25519", "key-agree", 0)}
SNK_05 = f"""WITH o AS ({bridge.OFFERS_SQL}), m AS (@MATRIX@),
    sj AS (SELECT * FROM (VALUES {', '.join(f"({c}, '{j}')" for c, j in _SUITES_JSON.items())}) v(code, json)),
    aj AS (SELECT * FROM (VALUES {', '.join(f"({c}, 'crypto/algorithm/{n}-{p}', '{_algorithm_json(n, p, m)}')" for c, parts in _SUITE.items() for n, p, m in parts)}) v(code, ref, json)),
    gj AS (SELECT * FROM (VALUES {', '.join(f"({c}, 'crypto/algorithm/{n}-{p}', '{_algorithm_json(n, p, None, q)}')" for c, (n, p, q) in _GROUPS_SQL.items())}) v(code, ref, json)),
    d AS (SELECT server, capability FROM m WHERE state = 'DEMONSTRATED'),
    vs AS (SELECT server, version FROM (VALUES (771, 'version:0x0303'), (772, 'version:0x0304')) v(version, capability) JOIN d USING (capability)),
    ps AS (SELECT DISTINCT o.server, o.version, o.selected FROM o JOIN vs ON o.server = vs.server AND o.version = vs.version JOIN d ON d.server = o.server AND d.capability = printf('cipher:0x%04x', o.selected)),
    pc AS (SELECT vs.server, vs.version, 'crypto/protocol/TLS-' || CASE vs.version WHEN 771 THEN '1.2' ELSE '1.3' END || '@' || vs.server AS ref, CASE vs.version WHEN 771 THEN '1.2' ELSE '1.3' END AS label,
                  coalesce(string_agg(sj.json, ',' ORDER BY selected), '') AS suites FROM vs LEFT JOIN ps ON vs.server = ps.server AND vs.version = ps.version LEFT JOIN sj ON sj.code = ps.selected GROUP BY vs.server, vs.version),
    pv AS (SELECT server, version, list(DISTINCT ref ORDER BY ref) AS refs FROM ps JOIN aj ON aj.code = selected GROUP BY server, version),
    cs AS (SELECT server, ref, '{{"bom-ref":"' || ref || '","cryptoProperties":{{"assetType":"protocol","protocolProperties":{{"cipherSuites":[' || suites || '],"type":"tls","version":"' || label || '"}}}},"name":"TLS ' || label || '","properties":[{{"name":"server","value":"' || server || '"}}],"type":"cryptographic-asset"}}' AS json FROM pc
        UNION SELECT ps.server, aj.ref, aj.json FROM ps JOIN aj ON aj.code = selected
        UNION SELECT server, ref, json FROM o JOIN gj ON code = CASE WHEN session % 100 = 0 THEN 4588 ELSE 29 END WHERE session % 50 = 0),
    ed AS (SELECT pc.server, string_agg('{{"provides":[' || coalesce('"' || array_to_string(refs, '","') || '"', '') || '],"ref":"' || ref || '"}}', ',' ORDER BY coalesce(refs, []), ref) AS edges FROM pc LEFT JOIN pv ON pc.server = pv.server AND pc.version = pv.version GROUP BY pc.server),
    sh AS (SELECT DISTINCT server, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('wirepost:cbom:' || server)) AS h FROM cs),
    id AS (SELECT server, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', CAST(CAST('0x' || h[17:17] AS INTEGER) % 4 + 1 AS BIGINT), 1) || h[18:20], h[21:32]) AS serial FROM sh)
    SELECT cs.server AS by, '{{"bomFormat":"CycloneDX","components":[' || string_agg(json, ',' ORDER BY ref) || '],"dependencies":[' || coalesce(any_value(edges), '') || '],"serialNumber":"urn:uuid:' || any_value(serial) || '","specVersion":"1.6","version":1}}' AS document
    FROM cs LEFT JOIN ed ON cs.server = ed.server JOIN id ON cs.server = id.server GROUP BY cs.server"""


def snk_02(s, d):
    return reports.summaries(bridge.sessions(s, d), bridge.findings(s, d), "server")


def snk_01(s, d):
    """The same documents laid out for files; as digests."""
    return reports.indented(snk_02(s, d), "report").select("server", F.sha2("report", 256).alias("sha"))


def agg_28(s, d):
    return reports.averages(bridge.sessions(s, d).select("server", F.col("session").alias("key"), (F.col("session") % 101).alias("score")), "server", "key", "score")


def vectors(s, d):
    """orders as uint16 vectors in hexadecimal: one or two bytes of length, some with an odd length, some with a byte too many, some cut."""
    k = F.col("o_orderkey")
    codes = F.transform(F.sequence(F.lit(1), (k % 5).cast("int") + 1), lambda i: (k * 31 + i * 7919) % 65536)
    body = F.concat(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 4, "0")), ""), F.when(k % 11 == 0, "AA").otherwise(""))
    head = F.lpad(F.hex((F.length(body) / 2).cast("long")), F.when(k % 2 == 1, 4).otherwise(2), F.lit("0"))
    data = F.concat(head, F.when(k % 17 == 0, F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body")), F.when(k % 13 == 0, "BB").otherwise(""))
    return table(s, d, "orders").withColumn("body", body).select(k.alias("k"), (k % 2 + 1).cast("int").alias("prefix"), F.unhex(data).alias("data"))


def bin_02(s, d):
    return handshakes.code_vectors(vectors(s, d), "data", "prefix").select("k", "codes", "status")


def hello_bytes(s, d):
    """(flow, dir, data): orders as handshake records: a ClientHello with GREASE, three extensions and a name, and the server's answer."""
    k, lit, cat = F.col("o_orderkey"), F.lit, F.concat
    h = lambda c, n: F.lpad(F.hex(c), n, F.lit("0"))
    sized = lambda c, n: cat(h((F.length(c) / 2).cast("long"), n), F.col(c))
    name = cat(lit("MX"), (k % 50).cast("string"), lit(".Example.ORG"), F.when(k % 3 == 0, ".").otherwise(""), F.when(k % 7 == 0, "_").otherwise(""))
    steps = [  # each a column of its own, as a length needs its body twice
        ("name", F.hex(F.encode(name, "US-ASCII"))),
        ("entry", cat(lit("00"), sized("name", 4))),
        ("list", sized("entry", 4)),
        ("sni", cat(lit("0000"), sized("list", 4))),
        ("offer", cat(lit("1A1A"), F.when(k % 2 == 0, "0304").otherwise(""), lit("0303"))),
        ("offers", sized("offer", 2)),
        ("versions", cat(lit("002B"), sized("offers", 4))),
        ("group", cat(h(k % 100 + 20, 4), lit("001D"))),
        ("groups", sized("group", 4)),
        ("curves", cat(lit("000A"), sized("groups", 4))),
        ("extensions", cat("sni", "versions", "curves", F.when(k % 11 == 0, F.col("curves")).otherwise(""))),
        ("ciphers", cat(lit("2A2A"), h(k % 7 + 0xC02B, 4), lit("1301"), F.when(k % 5 == 0, "5600").otherwise(""))),
        ("client", cat(lit("0303"), F.repeat(lit("11"), 32), lit("00"), sized("ciphers", 4), lit("0100"), sized("extensions", 4))),
        ("chosen", F.when(k % 13 == 0, "0303").otherwise("0304")),
        ("choice", cat(lit("002B"), sized("chosen", 4))),
        ("random", cat(F.repeat(lit("22"), 24), F.when(k % 2 == 0, "2222222222222222").otherwise("444F574E47524401"))),
        ("server", cat(lit("0303"), F.col("random"), lit("00"), h(k % 7 + 0xC02B, 4), lit("00"), F.when(k % 2 == 0, sized("choice", 4)).otherwise(""))),
        ("asked", cat(lit("01"), sized("client", 6))),
        ("told", cat(lit("02"), sized("server", 6))),
    ]
    rows = table(s, d, "orders").select("o_orderkey")
    for column, made in steps:
        rows = rows.withColumn(column, made)
    both = F.array(F.struct(lit("c2s").alias("dir"), cat(lit("00FF160303"), sized("asked", 4)).alias("hex")), F.struct(lit("s2c").alias("dir"), cat(lit("160303"), sized("told", 4)).alias("hex")))
    sent = rows.select(k.cast("string").alias("flow"), F.explode(both).alias("m"))
    return sent.select("flow", "m.dir", F.unhex("m.hex").alias("data"), F.array().cast("array<int>").alias("disputed"))


def bin_06(s, d):
    rows = handshakes.hellos(handshakes.messages(hello_bytes(s, d).where("dir = 'c2s'")))
    return rows.select(F.col("flow").cast("long").alias("k"), *(F.col(f"client.{c}").alias(c) for c in ("ciphers", "versions", "groups", "fallback", "server_name", "status")))


def bin_07(s, d):
    rows = handshakes.hellos(handshakes.messages(hello_bytes(s, d).where("dir = 's2c'")))
    return rows.select(F.col("flow").cast("long").alias("k"), *(F.col(f"server.{c}").alias(c) for c in ("cipher", "version", "sentinel", "status")))


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body


def certificate_kinds() -> list[tuple[int, bytes]]:
    """The sixty certificates that orders stand for, by the remainder of their key: names, signature and key by its own remainders."""
    algorithms = [tlv(0x30, bytes.fromhex(x)) for x in ("06092A864886F70D01010B", "06092A864886F70D010105", "06082A8648CE3D040303")]
    name = lambda n: tlv(0x30, tlv(0x31, tlv(0x30, bytes.fromhex("0603550403"), tlv(0x0C, b"a%d" % n))))
    rsa = lambda size: tlv(0x30, tlv(0x30, bytes.fromhex("06092A864886F70D0101010500")), tlv(3, b"\0", tlv(0x30, tlv(2, b"\0\xc1" + b"U" * (size - 1)), bytes.fromhex("0203010001"))))
    curve = tlv(0x30, tlv(0x30, bytes.fromhex("06072A8648CE3D020106082A8648CE3D030107")), bytes.fromhex("03020004"))
    validity = tlv(0x30, tlv(0x17, b"240101000000Z"), tlv(0x17, b"260101000000Z"))
    out = []
    for r in range(60):
        key = curve if r % 5 == 0 else rsa(256 if r % 2 == 0 else 128)
        body = tlv(0x30, bytes.fromhex("A003020102020105"), algorithms[r % 3], name(r % 4), validity, name(r % 3), key)
        out.append((r, tlv(0x30, body, algorithms[r % 3], bytes.fromhex("0304007369AA"))))
    return out


def certificates_of(s, d):
    """(k, der): orders as certificates in DER, some cut."""
    kinds = s.createDataFrame(certificate_kinds(), "r int, whole binary")  # sixty rows
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(k.alias("k"), (k % 60).cast("int").alias("r")).join(F.broadcast(kinds), "r")
    return rows.select("k", F.when(F.col("k") % 23 == 0, F.substring("whole", 1, 40)).otherwise(F.col("whole")).alias("der"))


def bin_10(s, d):
    return certificates.certificate_fields(certificates_of(s, d)).select("k", "cert.status", "cert.self_signed", "cert.signature_hash", "cert.key_kind", "cert.key_bits", "cert.curve", "cert.key_strength", F.col("cert.not_after").cast("long").alias("not_after"))


def mth_09(s, d):
    """Isolation of embeddings by their first 20 components."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 20), lambda x: x.cast("double")).alias("features"))
    return forest.isolation(rows, forest.forest(rows))


def jon_06(s, d):
    return lines.capability_windows(verdicts.flow_lines(s, d)).select("flow", "ehlo", "next")


def win_14(s, d):
    return lines.capability_windows(verdicts.flow_lines(s, d)).select("flow", "words")


def jon_09(s, d):
    return lines.tagged_replies(verdicts.flow_lines(s, d))


QUERIES = {
    "jon_06": jon_06,
    "win_14": win_14,
    "jon_09": jon_09,
    "bin_10": bin_10,
    "mth_09": mth_09,
    "flt_07": flt_07,
    "flt_08": flt_08,
    "flt_09": flt_09,
    "flt_23": lambda s, d: reasons(s, d, F.lit(False)),
    "prj_18": lambda s, d: reasons(s, d, F.col("session") % 13 == 0),
    "jon_12": jon_12,
    "prj_02": prj_02,
    "prj_06": prj_06,
    "prj_09": prj_09,
    "prj_12": prj_12,
    "prj_13": prj_13,
    "dom_17": dom_17,
    "win_07": win_07,
    "win_08": win_08,
    "srt_03": srt_03,
    "srt_04": srt_04,
    "set_08": set_08,
    "jon_16": jon_16,
    "jon_17": lambda s, d: jon_16(s, d, newest_only=False),
    "dom_09": dom_09,
    "agg_17": lambda s, d: reports.inventory(used(s, d), "server"),
    "snk_05": snk_05,
    "snk_01": snk_01,
    "snk_02": snk_02,
    "agg_28": agg_28,
    "str_12": lambda s, d: table(s, d, "pages").select("page_id", reports.named_uuid(F.coalesce("url", F.lit(""))).alias("serial")),
    "bin_12": lambda s, d: table(s, d, "pages").select("page_id", reports.hex_window(F.substring(F.encode(F.coalesce("url", F.lit("")), "UTF-8"), 1, 16)).alias("window")),
    "bin_02": bin_02,
    "bin_06": bin_06,
    "bin_07": bin_07,
}
LIT = "[" + ", ".join(f"'{x}'" for x in LITERALS) + f"][o_orderkey % {10**9} % {len(LITERALS)} + 1]"
TIERS = "['OBSERVED', 'DEDUCED', 'INFERRED', 'NOT_OBSERVABLE']"
LINES = f"""WITH l AS (SELECT o_custkey AS flow, o_orderkey AS pos, o_orderkey // 2 % 2 = 0 AS c, {_SQL_SAMPLES}[o_orderkey % {len(SAMPLES)} + 1] AS line FROM orders),
    e AS (SELECT flow, min(pos) AS ehlo FROM l WHERE c AND regexp_matches(upper(line), '^EHLO([ \\t]|\\r?\\n)') GROUP BY flow),
    n AS (SELECT e.flow, ehlo, (SELECT min(pos) FROM l WHERE l.flow = e.flow AND c AND pos > ehlo) AS next FROM e)"""
ORACLES = {
    "jon_06": f"{LINES} SELECT * FROM n",
    "win_14": f"""{LINES} SELECT n.flow, coalesce(list(regexp_extract(upper(line), '^250[ -]([^ \\t\\r\\n]+)', 1) ORDER BY pos) FILTER (WHERE regexp_matches(upper(line), '^250[ -][^ \\t\\r\\n]')), []) AS words
        FROM n LEFT JOIN l ON l.flow = n.flow AND NOT c AND pos > ehlo AND (next IS NULL OR pos < next) GROUP BY n.flow""",
    "jon_09": f"""{LINES}, t AS (SELECT flow, pos, c, regexp_extract(line, '^([^ \\t\\r\\n]+)[ \\t]', 1) AS tag FROM l), a AS (SELECT flow, tag, min(pos) AS asked FROM t WHERE c AND tag <> '' GROUP BY ALL)
        SELECT *, (SELECT min(pos) FROM t WHERE t.flow = a.flow AND t.tag = a.tag AND NOT c AND pos > asked) AS replied FROM a""",
    "bin_10": """SELECT o_orderkey AS k, CASE WHEN bad THEN 'malformed' ELSE 'complete' END AS status, CASE WHEN NOT bad THEN o_orderkey % 4 = o_orderkey % 3 END AS self_signed,
        CASE WHEN NOT bad THEN ['sha256', 'sha1', 'sha384'][o_orderkey % 3 + 1] END AS signature_hash, CASE WHEN bad THEN NULL WHEN ec THEN 'EC' ELSE 'RSA' END AS key_kind,
        CAST(CASE WHEN bad THEN NULL WHEN ec THEN 256 WHEN o_orderkey % 2 = 0 THEN 2048 ELSE 1024 END AS INTEGER) AS key_bits, CASE WHEN NOT bad AND ec THEN 'secp256r1' END AS curve,
        CASE WHEN bad THEN 'NOT_OBSERVABLE' WHEN NOT ec AND o_orderkey % 2 = 1 THEN 'INVALID' ELSE 'VALID' END AS key_strength, CASE WHEN NOT bad THEN CAST(epoch(TIMESTAMP '2026-01-01') AS BIGINT) END AS not_after
        FROM (SELECT o_orderkey, o_orderkey % 23 = 0 AS bad, o_orderkey % 5 = 0 AS ec FROM orders)""",
    "flt_07": sql_rules("true"),
    "jon_12": sql_rules("session % 3 > 0"),
    "flt_08": f"""SELECT o_orderkey AS session, CASE WHEN x IN ('true', 'false') THEN 'bool' WHEN x IN ('null', 'none') THEN 'null' WHEN try_cast(x AS BIGINT) IS NOT NULL AND NOT contains(x, '_') AND NOT contains(x, '.') AND NOT contains(x, 'e') AND NOT contains(x, 'x') THEN 'int'
        WHEN x = '0x1f' THEN 'int' WHEN try_cast(x AS DOUBLE) IS NOT NULL AND NOT contains(x, '_') AND NOT contains(x, 'x') THEN 'float' ELSE 'str' END AS kind FROM (SELECT o_orderkey, lower({LIT}) AS x FROM orders)""",
    "flt_09": "SELECT event_id, json_extract_string(props, '$.k') AS found, json_extract_string(props, '$.k.x') AS beyond, json_extract_string(props, '$.none') AS missing FROM events",
    "flt_23": sql_reasons("false"),
    "prj_18": sql_reasons("session % 13 = 0"),
    "prj_02": f"""WITH l AS (SELECT o_custkey AS flow, o_orderkey AS pos, CASE WHEN o_orderkey // 2 % 2 = 0 THEN 'c2s' ELSE 's2c' END AS dir, upper({_SQL_SAMPLES}[o_orderkey % {len(SAMPLES)} + 1]) AS line FROM orders),
        h AS (SELECT flow, arg_min(line, pos) FILTER (WHERE dir = 'c2s') AS c, arg_min(line, pos) FILTER (WHERE dir = 's2c') AS s FROM l GROUP BY flow),
        g AS (SELECT flow, c, {{s}} AS s1, {{c}} AS c1 FROM h)
        SELECT flow, CASE WHEN s1 IS NULL AND c1 IS NOT NULL THEN c1 ELSE CASE WHEN s1 = 'smtp' OR c LIKE 'EHLO %' THEN 'smtp' ELSE s1 END END AS kind, s1 IS NULL AND c1 IS NOT NULL AS swapped FROM g""".format(
        **{x: f"CASE WHEN ({x} LIKE '220 %' OR {x} LIKE '220-%') AND contains({x}, 'SMTP') THEN 'smtp' WHEN {x} LIKE '* OK%' OR {x} LIKE '* PREAUTH%' THEN 'imap' WHEN {x} LIKE '+OK%' THEN 'pop3' END" for x in ("s", "c")}
    ),
    "prj_06": f"""{S} SELECT session, 'Key exchange ' || coalesce(key_group, 'unidentified group') || ' was selected' AS what,
        {TIERS}[greatest(2, list_position({TIERS}, group_tier), list_position({TIERS}, hybrid_tier))] AS tier,
        CASE WHEN session % 17 = 0 THEN 0.42 ELSE [1.0, 0.75, 0.5][session % 6 % 3 + 1] END::DOUBLE AS confidence, CASE WHEN session % 5 = 0 THEN 'own_id' ELSE 'pq_hybrid_observed' END AS remediation FROM s""",
    "prj_09": WIN_08 + """, q AS (SELECT flow, "at", line, dir, kind, kept AS body, length(line) AS n, CASE WHEN dir = 'c2s' THEN 'C' ELSE 'S' END AS p, ord(line) IN (20, 21, 22, 23) AND ord(substr(line, 2)) = 3 AS t FROM r WHERE i > 0)
        SELECT flow, "at", CASE
            WHEN t AND ord(line) = 22 THEN p || ': TLS ' || CASE ord(substr(line, 6)) WHEN 1 THEN 'ClientHello' WHEN 2 THEN 'ServerHello' ELSE 'handshake' END WHEN t THEN 'TLS Application Data (' || n || ' bytes)'
            WHEN dir = 'c2s' AND (body OR (kind = 'smtp' AND line LIKE 'BDAT %')) THEN 'C: [message body, ' || n || ' bytes, not displayed]'
            WHEN dir = 'c2s' AND kind = 'smtp' AND line LIKE 'AUTH %' THEN 'C: AUTH [REDACTED]'
            WHEN dir = 'c2s' AND kind = 'smtp' AND line SIMILAR TO '(DATA|EHLO|STARTTLS)[ \\r][\\s\\S]*' THEN 'C: ' || regexp_extract(line, '^[A-Z]+')
            WHEN dir = 'c2s' THEN 'C: [' || kind || ' data, ' || n || ' bytes, not displayed]'
            WHEN kind = 'smtp' AND regexp_matches(line, '^[0-9]{3}') THEN 'S: ' || substr(line, 1, 3) || ' SMTP response' WHEN kind = 'smtp' THEN 'S: [protocol data, not displayed]'
            WHEN kind = 'imap' THEN 'S: IMAP response' ELSE 'TCP segment (' || n || ' bytes)' END AS summary,
            CASE WHEN t THEN 'tls' WHEN dir = 's2c' AND kind = 'unknown' THEN 'tcp' ELSE kind END AS layer FROM q""",
    "prj_12": f"""{S} SELECT session, 'version' AS fact, version_tier AS tier FROM s WHERE protocol <> 'unknown' UNION ALL SELECT session, 'group', group_tier FROM s WHERE version = 'TLS1.3'
        UNION ALL SELECT session, 'cipher', cipher_tier FROM s WHERE version IS NOT NULL""",
    "prj_13": f"""{verdicts.SIGNALS} SELECT session, CASE WHEN n.version = 'TLS1.3' THEN g.fs ELSE 'UNKNOWN' END AS forward_secrecy, CASE WHEN session % 3 > 0 THEN ocsp ELSE 'not_observable' END AS ocsp_stapling FROM g JOIN n USING (session)""",
    "dom_17": f"""{S}, f AS (SELECT session, CASE WHEN session % 17 = 0 THEN 'SSL3.0' ELSE version END AS version, verdict, hybrid OR session % 11 = 0 AS hybrid FROM s WHERE session % 13 <> 0)
        SELECT s.session, 'version' AS fact, s.version AS wanted, f.version AS found FROM s LEFT JOIN f USING (session) WHERE s.session % 13 = 0 OR s.version IS DISTINCT FROM f.version
        UNION ALL SELECT s.session, 'verdict', s.verdict, f.verdict FROM s LEFT JOIN f USING (session) WHERE s.session % 13 = 0 OR s.verdict IS DISTINCT FROM f.verdict
        UNION ALL SELECT s.session, 'hybrid', CAST(s.hybrid AS VARCHAR), CAST(f.hybrid AS VARCHAR) FROM s LEFT JOIN f USING (session) WHERE s.session % 13 = 0 OR s.hybrid IS DISTINCT FROM f.hybrid""",
    "win_07": f'{WIN_07} SELECT flow, "at" FROM r WHERE kept',
    "win_08": f'{WIN_08} SELECT flow, "at", kept AS body FROM r WHERE i > 0',
    "srt_03": f"""WITH f AS ({bridge.FINDINGS_SQL}), e AS (SELECT DISTINCT server, CAST(session AS VARCHAR) AS a, line AS b, affected % 4 AS c, severity AS k FROM f)
        SELECT server, list(concat_ws('/', a, b, c, k) ORDER BY a, b, c, k) AS evidence FROM e GROUP BY server""",
    "srt_04": f"""WITH f AS ({bridge.FINDINGS_SQL}), e AS (SELECT DISTINCT session, line, [2, 0, 1, 3][line % 4 + 1] AS r FROM f) SELECT session, list(line ORDER BY r, line) AS places FROM e GROUP BY session""",
    "set_08": f"WITH o AS ({OFFERS_SQL}) SELECT server, list_sort(list(DISTINCT session)) AS sessions FROM o GROUP BY server",
    "jon_16": f"""{S}, k AS (SELECT session, server, version, {sql_pick(5, "NOT_OBSERVABLE", "VALID")} AS status, CASE WHEN session % 4 > 0 THEN 'f' || (session % 3) END AS fp FROM s),
        c AS (SELECT server, list_sort(list(DISTINCT fp)) AS fingerprints FROM k WHERE status = 'VALID' AND fp IS NOT NULL GROUP BY server)
        SELECT session, server, fingerprints, len(fingerprints) > 1 AS ambiguous FROM k JOIN c USING (server) WHERE version = 'TLS1.3' AND status = 'NOT_OBSERVABLE'""",
    "dom_09": f"""WITH o AS ({OFFERS_SQL}), v AS (SELECT server, session, version, unnest(versions) AS c FROM o),
        x AS (SELECT DISTINCT server, session, c, CASE WHEN c > version THEN -1 ELSE 1 END AS sign FROM v WHERE c >= version AND (c > version OR c = version) UNION SELECT server, session, version, 1 FROM o),
        n AS (SELECT server, c, count(DISTINCT session) FILTER (WHERE sign > 0) AS shown, count(DISTINCT session) FILTER (WHERE sign < 0) AS excluded FROM x GROUP BY ALL)
        SELECT DISTINCT server, session, 'version:0x0' || lower(to_hex(c)) AS capability, shown, excluded FROM x JOIN n USING (server, c) WHERE shown > 0 AND excluded > 0""",
    "agg_17": f"{USED} SELECT * FROM i",
    "snk_05": SNK_05.replace("@MATRIX@", correlation_plans.ORACLES["agg_19"]),
    "snk_02": f"""{SESS}, g AS (SELECT server, severity, count(*) AS n FROM ({bridge.FINDINGS_SQL}) GROUP BY ALL),
        m AS (SELECT server, string_agg('"' || severity || '":' || n, ',' ORDER BY severity) AS f FROM g GROUP BY server),
        t AS (SELECT server, count(*) AS n, count(*) FILTER (WHERE encrypted) AS e, count(*) FILTER (WHERE cleartext) AS c, count(*) FILTER (WHERE encrypted AND seen) AS o, count(*) FILTER (WHERE encrypted AND seen AND NOT safe) AS x FROM o GROUP BY server)
        SELECT t.server, '{{"cleartext":' || c || ',"encrypted":' || e || ',"exposed":' || x || ',"findings_by_severity":{{' || coalesce(f, '') || '}},"not_observable":' || (n - e - c) || ',"observable":' || o || ',"sessions_total":' || n || '}}' AS report
        FROM t LEFT JOIN m ON t.server = m.server""",
    "snk_01": f"""{SESS}, g AS (SELECT server, severity, count(*) AS n FROM ({bridge.FINDINGS_SQL}) GROUP BY ALL),
        m AS (SELECT server, string_agg('    "' || severity || '": ' || n, ',' || chr(10) ORDER BY severity) AS f FROM g GROUP BY server),
        t AS (SELECT server, count(*) AS n, count(*) FILTER (WHERE encrypted) AS e, count(*) FILTER (WHERE cleartext) AS c, count(*) FILTER (WHERE encrypted AND seen) AS o, count(*) FILTER (WHERE encrypted AND seen AND NOT safe) AS x FROM o GROUP BY server),
        r AS (SELECT t.server, list_value('"cleartext": ' || c, '"encrypted": ' || e, '"exposed": ' || x, '"findings_by_severity": {{' || CASE WHEN f IS NULL THEN '' ELSE chr(10) || f || chr(10) || '  ' END || '}}',
            '"not_observable": ' || (n - e - c), '"observable": ' || o, '"sessions_total": ' || n) AS parts FROM t LEFT JOIN m ON t.server = m.server)
        SELECT server, sha256('{{' || chr(10) || '  ' || array_to_string(parts, ',' || chr(10) || '  ') || chr(10) || '}}' || chr(10)) AS sha FROM r""",
    "str_12": """WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(url, ''))) AS x FROM pages)
        SELECT page_id, concat_ws('-', substr(x, 1, 8), substr(x, 9, 4), '5' || substr(x, 14, 3), ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1] || substr(x, 18, 3), substr(x, 21, 12)) AS serial FROM h""",
    "bin_12": "SELECT page_id, array_to_string(list_transform(range(least(16, octet_length(encode(coalesce(url, ''))))), lambda i: lower(substr(hex(encode(coalesce(url, ''))), 2 * i + 1, 2))), ' ') AS window FROM pages",
    "agg_28": f"{S} SELECT server, CAST(round_even(avg(session), 0) AS INTEGER) AS avg_key, CAST(round_even(avg(session % 101), 0) AS INTEGER) AS avg_score FROM s GROUP BY server",
    "bin_02": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0 THEN NULL WHEN o_orderkey % 11 = 0 OR (o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0) THEN NULL
          ELSE CASE WHEN o_orderkey % 17 = 0 THEN list_transform(range(1, o_orderkey % 5 + 2), lambda i: CASE WHEN i = o_orderkey % 5 + 1 THEN (o_orderkey * 31 + i * 7919) % 65536 // 256 * 256 + 187 ELSE (o_orderkey * 31 + i * 7919) % 65536 END)
               ELSE list_transform(range(1, o_orderkey % 5 + 2), lambda i: (o_orderkey * 31 + i * 7919) % 65536) END END AS codes,
        CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0 THEN 'truncated' WHEN o_orderkey % 11 = 0 OR (o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0) THEN 'malformed' ELSE 'complete' END AS status FROM orders""",
    "bin_06": """SELECT o_orderkey AS k, CASE WHEN bad THEN [] ELSE [o_orderkey % 7 + 49195, 4865] END AS ciphers, CASE WHEN bad THEN [] WHEN o_orderkey % 2 = 0 THEN [772, 771] ELSE [771] END AS versions,
        CASE WHEN bad THEN [] ELSE [o_orderkey % 100 + 20, 29] END AS groups, NOT bad AND o_orderkey % 5 = 0 AS fallback, CASE WHEN NOT bad AND o_orderkey % 7 > 0 THEN 'mx' || (o_orderkey % 50) || '.example.org' END AS server_name,
        CASE WHEN bad THEN 'malformed' ELSE 'complete' END AS status FROM (SELECT *, o_orderkey % 11 = 0 AS bad FROM orders)""",
    "bin_07": """SELECT o_orderkey AS k, CAST(o_orderkey % 7 + 49195 AS INTEGER) AS cipher, CAST(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 13 > 0 THEN 772 ELSE 771 END AS INTEGER) AS version, CASE WHEN o_orderkey % 2 = 1 THEN 'settled_on_1.2' END AS sentinel,
        CASE WHEN o_orderkey % 26 = 0 THEN 'malformed' ELSE 'complete' END AS status FROM orders""",
}
ORACLES["jon_17"] = ORACLES["jon_16"].replace("version = 'TLS1.3' AND ", "")
