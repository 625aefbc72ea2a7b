"""Queries of captures and verdicts: conversations sent as captures and read back, lines and sessions projected from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tls
from ..operators import flows, verdicts
from ..sources import captures
from .bridge import table
from .text import SAMPLES, _SQL_SAMPLES

#: Characters of hexadecimal text in a frame's payload.
PIECE = 2400


def sent_pieces(s, d):
    """conversations cut into payloads: (conv, turn, role, n, hex), one piece at least."""
    turns = table(s, d, "conversations").where("conv_id is not null")
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("hex"))
    last = F.greatest(F.floor((F.length("hex") - 1) / PIECE), F.lit(0)).cast("int")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    return each.withColumn("hex", F.substring("hex", F.col("n") * PIECE + 1, F.lit(PIECE)))


def as_captures(s, d, kind="pcap"):
    """(capture, content): each conversation as a pcap or pcapng file of raw IPv4; port 25 serves, bytes of a side count on from 1."""
    from pyspark.sql import Window

    order = ("turn", "role", "n", "hex")
    pieces = sent_pieces(s, d).withColumns({"up": F.col("role") == "user", "size": (F.length("hex") / 2).cast("long")})
    side = Window.partitionBy("conv", "up").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("seq", F.coalesce(F.sum("size").over(side), F.lit(0)) + 1)
    h = lambda c, n: F.lpad(F.hex(c), n, "0")
    client, port = F.concat(F.lit("0A"), h(F.col("conv") % 2**24, 6)), h(F.lit(30000) + F.col("conv") % 20000, 4)
    ends = lambda a, b: F.when(F.col("up"), F.concat(a, b)).otherwise(F.concat(b, a))
    ip = F.concat(F.lit("4500"), h(F.col("size") + 40, 4), F.lit("0000000040060000"), ends(client, F.lit("C0A80001")))
    packet = F.concat(ip, ends(port, F.lit("0019")), h(F.col("seq"), 8), F.lit("00000000501000000000" + "0000"), "hex")
    size = h(F.col("size") + 40, 8)
    if kind == "pcap":
        head = "A1B2C3D400020004" + "00" * 8 + "0000FFFF" + "00000065"
        record = F.concat(h(F.col("turn"), 8), F.lit("00000000"), size, size, packet)
    else:  # a section and one interface; times in microseconds, data padded to four bytes
        head = "0A0D0D0A0000001C1A2B3C4D00010000" + "FF" * 8 + "0000001C" + "00000001000000140065" + "0000" + "0000FFFF" + "00000014"
        whole = h(32 + F.ceil((F.col("size") + 40) / 4) * 4, 8)
        data = F.concat(packet, F.repeat(F.lit("00"), F.pmod(-F.col("size"), F.lit(4)).cast("int")))
        record = F.concat(F.lit("00000006"), whole, F.lit("00000000"), h(F.col("turn") * 1_000_000, 16), size, size, data, whole)
    gathered = rows.select("conv", F.struct(*order, record.alias("record")).alias("r")).groupBy("conv").agg(F.array_sort(F.collect_list("r")).alias("all"))
    content = F.unhex(F.concat(F.lit(head), F.array_join(F.transform("all", lambda r: r["record"]), "")))
    return gathered.select(F.col("conv").cast("string").alias("capture"), content.alias("content"))


def read_back(s, d, kind="pcap"):
    return captures.read(as_captures(s, d, kind))


def src_02(s, d, kind="pcap"):
    rows = read_back(s, d, kind)
    return rows.select(F.col("capture").cast("long").alias("conv"), "frame", F.col("ts").cast("long").alias("turn"), F.octet_length("payload").cast("long").alias("size"), "payload_off", F.lower(F.hex("payload")).alias("payload"))


PIECES = f"""WITH raw AS (SELECT conv_id AS conv, turn, coalesce(role, '') AS role, hex(encode(coalesce(text, ''))) AS hex FROM conversations WHERE conv_id IS NOT NULL),
    e AS (SELECT *, unnest(range(greatest((length(hex) - 1) // {PIECE}, 0) + 1)) AS n FROM raw),
    p AS (SELECT conv, turn, role, n, substr(hex, CAST(n * {PIECE} + 1 AS INTEGER), {PIECE}) AS hex FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn, role, n, hex) AS frame, CAST(length(hex) // 2 AS BIGINT) AS size FROM p)"""


def src_05(s, d):
    return captures.health(read_back(s, d)).select(F.col("capture").cast("long").alias("conv"), "frames", "tcp_segments", "ipv4", "frames_decoded_pct", "analysis_status")


def flow_segments(s, d):
    """Flows to segments of one direction: sequence numbers run on without a hole."""
    rows = flows.stream_segments(flows.generations(read_back(s, d)))
    return rows.groupBy(F.col("capture").cast("long").alias("conv"), "dir").agg(F.count("*").alias("segments"), F.min("seq").alias("first_seq"), F.max(F.col("seq") + F.length("hex") / 2).cast("long").alias("next_seq"))


def flow_lines(s, d):
    """orders as lines: the customer is the flow, the key the place; implicit flows and a place where TLS begins by remainders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.element_at(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("smtp", "smtp", "imap", "pop3", "unknown"))), (c % 5 + 1).cast("int"))
    own = table(s, d, "orders").select(c.alias("flow"), kind.alias("kind"), (c % 17 == 0).alias("implicit"), F.when(c % 3 == 0, c % 7 * 2000 + 1000).alias("tls_at"), F.when(F.floor(k / 2) % 2 == 0, "c2s").otherwise("s2c").alias("dir"), k.alias("at"), line.alias("line"))
    return own


def dom_01(s, d):
    return verdicts.transitions(flow_lines(s, d))


DOM_01 = f"""
    WITH l AS (
        SELECT o_custkey AS flow, ['smtp', 'smtp', 'imap', 'pop3', 'unknown'][o_custkey % 5 + 1] AS kind, o_custkey % 17 = 0 AS implicit,
               CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 * 2000 + 1000 END AS tls_at, o_orderkey // 2 % 2 = 0 AS c, o_orderkey AS pos,
               {_SQL_SAMPLES}[o_orderkey % {len(SAMPLES)} + 1] AS line
        FROM orders),
    u AS (SELECT *, upper(line) AS u, regexp_extract(line, '^([^ \\t\\r\\n]+)', 1) AS word FROM l),
    a AS (
        SELECT *,
               c AND ((kind = 'smtp' AND regexp_matches(u, '^STARTTLS([ \\t]|\\r?\\n)')) OR (kind = 'imap' AND regexp_matches(u, '^[^ \\t\\r\\n]+[ \\t]+STARTTLS([ \\t]|\\r?\\n)')) OR (kind = 'pop3' AND regexp_matches(u, '^STLS([ \\t]|\\r?\\n)'))) AS asks,
               c AND ((kind = 'smtp' AND regexp_matches(u, '^AUTH([ \\t]|\\r?\\n)')) OR (kind = 'imap' AND regexp_matches(u, '^[^ \\t\\r\\n]+[ \\t]+AUTHENTICATE([ \\t]|\\r?\\n)')) OR (kind = 'pop3' AND regexp_matches(u, '^(AUTH|USER|PASS)([ \\t]|\\r?\\n)'))) AS auth
        FROM u),
    b AS (
        SELECT flow, any_value(kind) AS kind, any_value(implicit) AS implicit, any_value(tls_at) AS tls_at, min(pos) FILTER (WHERE asks) AS asked,
               arg_min(word, pos) FILTER (WHERE asks) AS tag, min(pos) FILTER (WHERE c AND regexp_matches(u, '^EHLO([ \\t]|\\r?\\n)')) AS ehlo, coalesce(bool_or(auth), false) AS auth
        FROM a GROUP BY flow),
    r AS (
        SELECT a.flow, a.pos, CASE
            WHEN a.kind = 'smtp' THEN CASE WHEN regexp_matches(u, '^220([ -]|\\r?\\n)') THEN 'accepted' WHEN regexp_matches(u, '^5\\d\\d([ -]|\\r?\\n)') THEN 'rejected' WHEN regexp_matches(u, '^\\d{{3}}([ -]|\\r?\\n)') THEN 'other' END
            WHEN a.kind = 'imap' THEN CASE WHEN word <> tag THEN NULL WHEN regexp_matches(u, '^[^ \\t\\r\\n]+[ \\t]+OK([ \\t]|\\r?\\n)') THEN 'accepted' WHEN regexp_matches(u, '^[^ \\t\\r\\n]+[ \\t]+(NO|BAD)([ \\t]|\\r?\\n)') THEN 'rejected' END
            WHEN a.kind = 'pop3' THEN CASE WHEN u LIKE '+OK%' THEN 'accepted' WHEN u LIKE '-ERR%' THEN 'rejected' END END AS status
        FROM a JOIN b ON a.flow = b.flow WHERE NOT c AND a.pos > asked),
    first_reply AS (SELECT flow, min(pos) AS pos, arg_min(status, pos) AS status FROM r WHERE status IS NOT NULL GROUP BY flow),
    next AS (SELECT a.flow, min(a.pos) AS pos FROM a JOIN b ON a.flow = b.flow WHERE c AND a.pos > ehlo GROUP BY a.flow),
    blocks AS (
        SELECT a.flow, a.pos, u FROM a JOIN b ON a.flow = b.flow LEFT JOIN next ON a.flow = next.flow
        WHERE NOT c AND a.pos > ehlo AND (next.pos IS NULL OR a.pos < next.pos) AND regexp_matches(u, '^250[ -][^ \\t\\r\\n]')),
    listed AS (
        SELECT flow, bool_or(regexp_matches(u, '^250[ -]STARTTLS([ \\t\\r\\n]|$)')) AS listed, bool_or(u LIKE '250 %') AS ended,
               min(pos) FILTER (WHERE regexp_matches(u, '^250[ -][A-Z]{{8}}([ \\t\\r\\n]|$)') AND NOT regexp_matches(u, '^250[ -](STARTTLS|CHUNKING|SMTPUTF8)')) AS odd
        FROM blocks GROUP BY flow),
    t AS (
        SELECT b.*, f.pos AS replied, f.status, listed.listed, listed.ended, b.kind IN ('smtp', 'imap', 'pop3') AND NOT b.implicit AS read,
               CASE WHEN f.status = 'accepted' THEN f.pos ELSE b.asked END AS after, odd
        FROM b LEFT JOIN first_reply f ON b.flow = f.flow LEFT JOIN listed ON b.flow = listed.flow),
    v AS (
        SELECT t.flow, any_value(t) AS t, coalesce(bool_or(a.pos > t.after), false) AS later, coalesce(bool_or(a.auth AND a.pos > t.odd), false) AS odd_auth,
               any_value(CASE WHEN t.read AND t.kind = 'smtp' THEN CASE WHEN t.listed THEN true WHEN t.ended THEN false END END) AS offered
        FROM t JOIN a ON t.flow = a.flow GROUP BY t.flow)
    SELECT flow, offered AS starttls_offered, t.auth AND t.read AS auth_cleartext,
           CASE WHEN t.implicit THEN 'upgraded' WHEN NOT t.read THEN 'not_used' WHEN t.asked IS NOT NULL AND t.status = 'rejected' THEN 'rejected'
                WHEN t.asked IS NOT NULL AND t.status = 'accepted' AND t.tls_at > t.replied THEN 'upgraded' WHEN t.asked IS NOT NULL THEN 'failed'
                WHEN NOT offered AND odd_auth THEN 'suspected' ELSE 'not_used' END AS verdict,
           CASE WHEN t.implicit THEN 'certain' WHEN NOT t.read THEN 'inferred' WHEN t.asked IS NOT NULL AND t.status = 'rejected' THEN 'certain'
                WHEN t.asked IS NOT NULL AND t.status = 'accepted' AND t.tls_at > t.replied THEN 'certain' WHEN t.asked IS NOT NULL THEN CASE WHEN later THEN 'certain' ELSE 'inferred' END
                WHEN NOT offered AND odd_auth THEN 'inferred' WHEN t.auth THEN 'certain' ELSE 'inferred' END AS band
    FROM v"""


def negotiated(s, d):
    """orders as sessions with what was negotiated, by remainders of the key."""
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n % len(values) + 1).cast("int"))
    return table(s, d, "orders").select(
        k.alias("session"),
        pick(7, "TLS1.3", "TLS1.2", "TLS1.0", None, "SSL3.0").alias("version"),
        pick(11, 0, 1, 2, None, 3).alias("delta"),
        pick(13, True, False, None).alias("cbc"),
        pick(17, "YES", "NO", "UNKNOWN").alias("fs"),
        pick(19, True, False, None).alias("expired"),
        pick(23, True, False).alias("self_signed"),
        pick(29, None, None, "RSA key below 2048 bits").alias("weak"),
        pick(29, "NOT_OBSERVABLE", "VALID", "INVALID").alias("key_strength"),
        pick(31, True, False, None).alias("hybrid"),
        F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, (tls.STATUS_REQUEST, tls.PRE_SHARED_KEY, tls.ECH, tls.EARLY_DATA, tls.KEY_SHARE))), ((k + i * i) % 5 + 1).cast("int")))).alias("client"),
        F.when(k % 3 > 0, F.array(F.when(k % 2 == 0, tls.KEY_SHARE).otherwise(tls.PRE_SHARED_KEY), F.when(k % 37 == 0, tls.STATUS_REQUEST).otherwise(1))).alias("server"),
        F.array(F.lit(2), F.when(k % 41 == 0, 22).otherwise(11)).alias("types"),
        pick(43, 0x0304, 0x0303, None).alias("number"),
        pick(47, None, "settled_on_1.2").alias("sentinel"),
        F.when(k % 2 == 0, F.array(F.lit(0x0304), F.lit(0x0303))).alias("offered"),
    )


def _pick(n, *values):
    items = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'" for v in values)
    return f"[{items}][o_orderkey % {n} % {len(values)} + 1]"


N = f"""WITH n AS (
    SELECT o_orderkey AS session, {_pick(7, "TLS1.3", "TLS1.2", "TLS1.0", None, "SSL3.0")} AS version, {_pick(11, 0, 1, 2, None, 3)} AS delta, {_pick(13, True, False, None)} AS cbc,
           {_pick(17, "YES", "NO", "UNKNOWN")} AS fs, {_pick(19, True, False, None)} AS expired, {_pick(23, True, False)} AS self_signed, {_pick(29, None, None, "RSA key below 2048 bits")} AS weak,
           {_pick(29, "NOT_OBSERVABLE", "VALID", "INVALID")} AS key_strength, {_pick(31, True, False, None)} AS hybrid,
           CASE WHEN o_orderkey % 5 > 0 THEN list_transform(range(o_orderkey % 5 + 1), lambda i: [5, 41, 65037, 42, 51][(o_orderkey + i * i) % 5 + 1]) ELSE [] END AS client,
           CASE WHEN o_orderkey % 3 > 0 THEN [CASE WHEN o_orderkey % 2 = 0 THEN 51 ELSE 41 END, CASE WHEN o_orderkey % 37 = 0 THEN 5 ELSE 1 END] ELSE [] END AS server,
           o_orderkey % 41 = 0 AS stapled, {_pick(43, 0x0304, 0x0303, None)} AS number, {_pick(47, None, "settled_on_1.2")} AS sentinel, o_orderkey % 2 = 0 AS new
    FROM orders),
    f AS (SELECT *, coalesce(expired, false) OR self_signed OR weak IS NOT NULL AS bad, expired IS NULL OR key_strength = 'NOT_OBSERVABLE' AS unsure FROM n),
    c AS (SELECT *, CASE WHEN bad THEN 'INVALID' WHEN unsure THEN 'INDETERMINATE' ELSE 'VALID' END AS status FROM f)"""


def judged(s, d):
    return negotiated(s, d).withColumn("c", verdicts.certificate_verdict(F.col("expired"), F.col("self_signed"), F.col("weak"), F.col("key_strength")))


def dom_06(s, d):
    return judged(s, d).select("session", "c.status", "c.reason")


def dom_07(s, d):
    return verdicts.rule_findings(judged(s, d).withColumn("cert_status", F.col("c.status"))).select("session", "rule", "severity")


def signals(s, d):
    rows = negotiated(s, d).select("session", "client", "server", "types", F.col("number").alias("version"), F.col("cbc").alias("static_kex"), "offered", "sentinel")
    return tls.with_signals(rows).select("session", *tls.SIGNALS)


def dom_04(s, d):
    return signals(s, d).withColumnsRenamed({"ocsp_stapling": "ocsp", "forward_secrecy": "fs"})


SIGNALS = f"""{N}, g AS (
    SELECT session, list_contains(client, 5) AS status_request_sent, list_contains(client, 42) AS early_data_offered, list_contains(client, 65037) AS ech_offered, list_contains(client, 41) AS psk_offered,
           CASE WHEN NOT list_contains(client, 5) THEN 'not_requested' WHEN number = 772 THEN 'not_observable' WHEN stapled OR list_contains(server, 5) THEN 'provided' ELSE 'requested_not_provided' END AS ocsp,
           CASE WHEN number = 772 THEN CASE WHEN list_contains(server, 41) AND NOT list_contains(server, 51) THEN 'NO' ELSE 'YES' END WHEN cbc IS NULL THEN 'UNKNOWN' WHEN cbc THEN 'NO' ELSE 'YES' END AS fs,
           sentinel IS NOT NULL AND new AS downgrade_anomaly, sentinel IS NOT NULL AND NOT new AS downgrade_legacy_client
    FROM n)"""


def dom_08(s, d):
    """Signals as sessions; a third of them has no evidence for what it shows."""
    proof = F.when(F.col("session") % 3 > 0, F.array(F.col("session"))).otherwise(F.array().cast("array<long>"))
    rows = signals(s, d).withColumn("has_fallback_scsv", F.col("session") % 53 == 0)
    rows = rows.withColumns({f"evidence_{signal}": proof for signal, *_ in verdicts.SIGNAL_RULES.values()})
    return verdicts.signal_findings(rows).select("session", "rule", "severity", "band")


_R = {r: f"CASE WHEN delta >= 2 THEN 'critical' ELSE '{s}' END" if r == "TLS-VER-DEPRECATED" else f"'{s}'" for r, s in verdicts.RULES.items()}
_MET = ("version IN ('SSL3.0', 'TLS1.0', 'TLS1.1')", "delta >= 2", "cbc", "version <> 'TLS1.3' AND fs = 'NO'", "status = 'INVALID' AND expired", "status = 'INVALID' AND self_signed", "key_strength = 'INVALID'", "hybrid")
_SIGNAL_MET = ("downgrade_anomaly", "downgrade_legacy_client", "session % 53 = 0", "fs = 'NO'", "early_data_offered", "ech_offered", "ocsp = 'requested_not_provided'")

QUERIES = {"src_02": src_02, "src_03": lambda s, d: src_02(s, d, "pcapng"), "src_05": src_05, "flow_segments": flow_segments, "dom_01": dom_01, "dom_04": dom_04, "dom_06": dom_06, "dom_07": dom_07, "dom_08": dom_08}
ORACLES = {
    "src_02": f"{PIECES} SELECT conv, frame, turn, size, CAST(40 AS INTEGER) AS payload_off, lower(hex) AS payload FROM f",
    "src_03": f"{PIECES} SELECT conv, frame, turn, size, CAST(40 AS INTEGER) AS payload_off, lower(hex) AS payload FROM f",
    "src_05": f"{PIECES} SELECT conv, count(*) AS frames, count(*) AS tcp_segments, count(*) AS ipv4, CAST(100 AS DOUBLE) AS frames_decoded_pct, 'complete' AS analysis_status FROM f GROUP BY conv",
    "flow_segments": f"{PIECES} SELECT conv, CASE WHEN role = 'user' THEN 'c2s' ELSE 's2c' END AS dir, count(*) AS segments, CAST(1 AS BIGINT) AS first_seq, CAST(1 + sum(size) AS BIGINT) AS next_seq FROM f GROUP BY conv, role = 'user'",
    "dom_01": DOM_01,
    "dom_04": f"{SIGNALS} SELECT * FROM g",
    "dom_06": f"""{N} SELECT session, status, nullif(concat_ws('; ', CASE WHEN expired THEN 'expired at capture time' END, CASE WHEN self_signed THEN 'self-signed' END, weak,
        CASE WHEN expired IS NULL THEN 'capture time unknown' END, CASE WHEN key_strength = 'NOT_OBSERVABLE' THEN 'unsupported public-key type; key-strength check NOT_OBSERVABLE' END), '') AS reason FROM c""",
    "dom_07": N + " UNION ALL ".join(f" SELECT session, '{r}' AS rule, {_R[r]} AS severity FROM c WHERE {m}" for r, m in zip(verdicts.RULES, _MET, strict=True)),
    "dom_08": SIGNALS + " UNION ALL ".join(f" SELECT session, '{r}' AS rule, '{v[2]}' AS severity, '{v[3]}' AS band FROM g WHERE session % 3 > 0 AND ({m})" for (r, v), m in zip(verdicts.SIGNAL_RULES.items(), _SIGNAL_MET, strict=True)),
}
