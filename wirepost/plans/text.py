"""Queries of the mail grammar: protocol lines projected from orders, hosts from pages, lines from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mail
from ..operators import lines, windows
from .bridge import table

#: Lines that orders stand for, by the remainder of their key.
SAMPLES = (
    "220 mx.example.com ESMTP ready\r\n", "220-Mail.Example.ORG. SMTP\r\n", "* OK IMAP4 ready\r\n", "* preauth hello\r\n", "+OK pop ready\r\n", "EHLO client.example\r\n",
    "AUTH PLAIN xyz\r\n", "a1 AUTHENTICATE PLAIN\r\n", "USER someone\r\n", "PASS secret\r\n", "STARTTLS\r\n", "starttls\n", "a2 StartTLS\r\n", "STLS\r\n", "454 try later\r\n", "502-no\r\n",
    "a2 OK begin\r\n", "a2 BAD no\r\n", "a3 OK begin\r\n", "-ERR no\r\n", "250-STARTTLS\r\n", "250 XXXXXXXA\r\n", "250-PIPELINING\r\n", "250 SMTPUTF8\r\n", "220 bad_host! ESMTP\r\n", "DATA\r\n", "BDAT 86\r\n", "AUTHOR\r\n", "quit", "",
)
_SQL_SAMPLES = "[" + ", ".join("'" + x.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'" for x in SAMPLES) + "]"
O = f"WITH o AS (SELECT o_orderkey AS k, {_SQL_SAMPLES}[o_orderkey % {len(SAMPLES)} + 1] AS line, ['smtp', 'imap', 'pop3', 'unknown'][o_orderkey // {len(SAMPLES)} % 4 + 1] AS kind FROM orders), u AS (SELECT *, upper(line) AS u FROM o)"


def sampled(s, d):
    k = F.col("o_orderkey")
    line = F.element_at(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("smtp", "imap", "pop3", "unknown"))), (F.floor(k / len(SAMPLES)) % 4 + 1).cast("int"))
    return table(s, d, "orders").select(k.alias("k"), line.alias("line"), kind.alias("kind"))


#: Fields that cited lines stand for, by the remainder of their key.
FIELDS = ("protocol.line", "tls.record", "tls.server_hello.key_share.group", "smtp.capability", "smtp.banner.hostname", "smtp.body", "protocol.line", "tls.server_hello.version", "cleartext-auth")


def prj_10(s, d):
    """What of a cited line may be shown: spans of a payload of two lines, some from its middle, some beyond its end."""
    k = F.col("k")
    rows = sampled(s, d).withColumn("field", F.element_at(F.array(*map(F.lit, FIELDS)), (k % len(FIELDS) + 1).cast("int")))
    rule = F.when(k % 11 == 0, "CLEARTEXT-AUTH").otherwise("OTHER")
    word = F.regexp_replace("line", r"[\r\n]", "")
    rows = rows.withColumns({"payload": F.concat(F.lit("QUIT\r\n"), "line"), "start": F.when(k % 13 == 0, 7).when(k % 17 == 0, 900).otherwise(6), "length": F.when(k % 5 == 0, F.length("line") + 1).otherwise(F.length(word))})
    shown = windows.window(rule, F.col("field"), F.col("payload"), F.col("start"), F.col("length"))
    return rows.select("k", shown.alias("w")).select("k", "w.*")


PRJ_10 = f"""{O},
    f AS (SELECT k, list_value({', '.join(f"'{x}'" for x in FIELDS)})[k % {len(FIELDS)} + 1] AS field, k % 11 = 0 AS login, 'QUIT' || chr(13) || chr(10) || line AS payload,
                 CASE WHEN k % 13 = 0 THEN 7 WHEN k % 17 = 0 THEN 900 ELSE 6 END AS start, CASE WHEN k % 5 = 0 THEN length(line) + 1 ELSE length(replace(replace(line, chr(13), ''), chr(10), '')) END AS n FROM o),
    g AS (SELECT *, substr(payload, start + 1, n) AS span FROM f),
    h AS (SELECT *, regexp_extract(span, '(?i)^([2-5]\\d\\d)([ \\t\\r\\n-]|$)', 1) || regexp_extract(span, '(?i)^(\\+OK|-ERR|EHLO|HELO|LHLO|STARTTLS|STLS|CAPA|QUIT|NOOP|RSET|DATA)([ \\t\\r\\n]|$)', 1) AS head FROM g),
    w AS (SELECT *, CASE WHEN login OR field = 'cleartext-auth' THEN 'AUTH PLAIN [REDACTED]' WHEN contains(field, 'key_share') THEN 'TLS key-share [not displayed]' WHEN start > length(payload) OR length(span) <> n THEN '[evidence bytes not displayed]'
            WHEN field LIKE 'tls.%' OR (field = 'smtp.capability' AND regexp_full_match(span, '[A-Z][A-Z0-9-]{{0,31}}')) OR (field = 'smtp.banner.hostname' AND regexp_full_match(span, '[A-Za-z0-9]([A-Za-z0-9.-]{{0,252}}[A-Za-z0-9])?')) THEN NULL
            WHEN field = 'protocol.line' AND start = 6 AND head <> '' THEN NULL ELSE '[protocol text not displayed]' END AS why FROM h),
    x AS (SELECT *, CASE WHEN why IS NOT NULL THEN '' WHEN field = 'protocol.line' THEN head ELSE span END AS shown FROM w)
    SELECT k, regexp_replace(lower(hex(encode(shown))), '(..)', '\\1 ', 'g')[:greatest(3 * length(shown) - 1, 0)] AS hex, coalesce(why, regexp_replace(shown, '[^ -~]', '.', 'g')) AS ascii, n - length(shown) AS withheld FROM x"""


def doc_lines(s, d):
    """Lines of documents up to the first '!!': a stand-in for the record that ends cleartext."""
    return lines.complete_lines(table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", "!!")


D = """WITH b AS (SELECT doc_id, string_split(string_split(coalesce(text, ''), '!!')[1], chr(10)) AS ls FROM documents),
    e AS (SELECT doc_id, unnest(ls) || chr(10) AS line, unnest(range(len(ls))) AS n, len(ls) AS m FROM b),
    l AS (SELECT doc_id, CAST(n AS INTEGER) AS n, line, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e WHERE n < m - 1)"""


def str_03(s, d):
    return doc_lines(s, d).select("doc_id", "n", "start", F.length("line").alias("size"), F.md5("line").alias("line"))


def win_09(s, d):
    rows = doc_lines(s, d)
    return lines.before_content(rows, "doc_id", F.col("line").rlike("(?i)the that")).groupBy("doc_id").agg(F.count("*").alias("n"))


def jon_04(s, d):
    rows = doc_lines(s, d)
    spots = table(s, d, "documents").select("doc_id", F.explode(F.array(F.lit(40), F.lit(700))).alias("offset"))
    return lines.touched(rows, spots, "doc_id").where("disputed").select("doc_id", "n")


def hosts(s, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, host).alias("sni"), F.when(F.col("page_id") % 2 == 0, F.concat(F.upper(host), F.lit(".."))).alias("banner"), F.concat(F.lit("10.0.0."), (F.col("page_id") % 40).cast("string")).alias("ip"), F.lit(25).alias("port"))


H = """WITH h AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN x END AS sni, CASE WHEN page_id % 2 = 0 THEN upper(x) || '..' END AS banner, '10.0.0.' || (page_id % 40) AS ip, 25 AS port
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS x FROM pages)),
    i AS (SELECT *, coalesce(sni, lower(rtrim(banner, '.'))) AS host, CASE WHEN sni IS NOT NULL THEN 'tls_sni' WHEN banner IS NOT NULL THEN 'smtp_banner' ELSE 'network_endpoint' END AS source FROM h)"""


def identities(s, d):
    name, banner = mail.hostname(F.col("sni")), mail.hostname(F.col("banner"))
    source = F.when(name.isNotNull(), "tls_sni").when(banner.isNotNull(), "smtp_banner").otherwise("network_endpoint")
    return hosts(s, d).select("page_id", "ip", "port", F.coalesce(name, banner).alias("host"), source.alias("source"), "sni")


def jon_15(s, d):
    """Nameless sessions take the one name that their endpoint's other sessions agree on."""
    rows = identities(s, d)
    sole = rows.where("sni is not null").groupBy("ip", "port").agg(F.min("sni").alias("a"), F.max("sni").alias("b")).where("a = b").select("ip", "port", F.col("a").alias("sole"))
    return rows.join(sole, ["ip", "port"], "left").select("page_id", F.coalesce("host", "sole").alias("host"))


def jon_18(s, d):
    """Evidence rows met with the frames they cite."""
    wanted = table(s, d, "events").where("event_type = 'error'").select("user_id", "event_id")
    frames = table(s, d, "events").select("user_id", "event_id", "value")
    return frames.join(wanted, ["user_id", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("bytes"))


QUERIES = {
    "flt_04": lambda s, d: sampled(s, d).where((F.coalesce(mail.protocol(F.col("line"), F.col("line")), F.lit("unknown")) != "unknown") | (F.col("k") % 5 == 0)).select("k"),
    "flt_22": lambda s, d: sampled(s, d).select("k", mail.display_filter(F.col("k") - 100, F.col("k") % 7 - 3).alias("filter")),
    "jon_04": jon_04,
    "jon_15": jon_15,
    "jon_18": jon_18,
    "prj_01": lambda s, d: hosts(s, d).select("page_id", F.when(F.struct("ip", "port") < F.struct(F.lit("10.0.0.2"), F.lit(25)), F.col("ip")).otherwise("10.0.0.2").alias("server")),
    "prj_04": lambda s, d: hosts(s, d).select("page_id", mail.endpoint(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("fe80::"), F.col("page_id").cast("string"))).otherwise(F.col("ip")), F.col("port")).alias("endpoint")),
    "prj_05": lambda s, d: identities(s, d).select("page_id", mail.server_id(F.col("host"), mail.endpoint(F.col("ip"), F.col("port"))).alias("server")),
    "prj_10": prj_10,
    "prj_11": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(mail.printable(F.col("text"))).alias("printable")),
    "prj_15": lambda s, d: hosts(s, d).select("page_id", F.array_join(F.array_sort(F.array(mail.endpoint(F.col("ip"), F.col("port")), F.lit("10.0.0.20:993"))), "|").alias("flow")),
    "srt_02": lambda s, d: identities(s, d).select("ip", "port", "host").distinct().orderBy("ip", "port", F.coalesce("host", F.lit(""))),
    "str_01": lambda s, d: sampled(s, d).select("k", mail.protocol(F.col("line"), F.lit("")).alias("by_server"), mail.protocol(F.lit(""), F.col("line")).alias("by_client")),
    "str_02": lambda s, d: sampled(s, d).select("k", mail.classified(mail.protocol(F.col("line"), F.lit("")), F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, "imap")).alias("c")).select("k", "c.protocol", "c.tier"),
    "str_03": str_03,
    "str_04": lambda s, d: sampled(s, d).where(mail.is_auth(F.col("line"), F.col("kind"))).select("k", "kind"),
    "str_05": lambda s, d: sampled(s, d).select("k", mail.request_kind(F.col("line"), F.col("kind")).alias("request")),
    "str_06": lambda s, d: sampled(s, d).select("k", mail.reply_status(F.col("line"), F.col("kind"), F.lit("a2")).alias("status")),
    "str_07": lambda s, d: sampled(s, d).select("k", mail.capability(F.col("line")).alias("word")).where("word <> ''").select("k", "word", mail.suspicious_capability(F.col("word")).alias("suspicious")),
    "str_08": lambda s, d: hosts(s, d).select("page_id", mail.hostname(F.col("banner")).alias("host")),
    "str_09": lambda s, d: sampled(s, d).select("k", mail.banner_host(F.col("line")).alias("host")),
    "str_10": lambda s, d: identities(s, d).select("page_id", "host", "source"),
    "str_11": lambda s, d: table(s, d, "part").select("p_partkey", mail.slug(F.col("p_type")).alias("ref")),
    "str_14": lambda s, d: table(s, d, "events").select("event_id", mail.display_filter(F.col("user_id"), F.col("event_id")).alias("filter")),
    "win_09": win_09,
}
PROTO = lambda server, client: f"CASE WHEN (({server} LIKE '220 %' OR {server} LIKE '220-%') AND string_split({server}, chr(10))[1] LIKE '%SMTP%') OR {client} LIKE 'EHLO %' THEN 'smtp' WHEN {server} LIKE '* OK%' OR {server} LIKE '* PREAUTH%' THEN 'imap' WHEN {server} LIKE '+OK%' THEN 'pop3' END"
FILT = lambda a, b: f"concat_ws(' && ', CASE WHEN {a} >= 0 THEN 'tcp.stream eq ' || ({a}) END, CASE WHEN {b} >= 0 THEN 'frame.number == ' || ({b}) END)"
END = "([ \\t]|\\r?\\n)"
ORACLES = {
    "flt_04": f"{O} SELECT k FROM u WHERE {PROTO('u', 'u')} IS NOT NULL OR k % 5 = 0",
    "flt_22": f"{O} SELECT k, {FILT('k - 100', 'k % 7 - 3')} AS filter FROM o",
    "jon_04": f"{D} SELECT doc_id, n FROM l WHERE (40 >= start AND 40 < start + length(line)) OR (700 >= start AND 700 < start + length(line))",
    "jon_15": f"""{H}, s AS (SELECT ip, port, min(sni) AS sole FROM h WHERE sni IS NOT NULL GROUP BY ALL HAVING count(DISTINCT sni) = 1) SELECT page_id, coalesce(host, sole) AS host FROM i LEFT JOIN s USING (ip, port)""",
    "jon_18": "SELECT user_id, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events WHERE event_type = 'error' GROUP BY user_id",
    "prj_01": f"{H} SELECT page_id, CASE WHEN ip < '10.0.0.2' THEN ip ELSE '10.0.0.2' END AS server FROM h",
    "prj_04": f"{H} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '[fe80::' || page_id || ']' ELSE ip END || ':25' AS endpoint FROM h",
    "prj_05": f"{H} SELECT page_id, coalesce(host || '@', '') || ip || ':25' AS server FROM i",
    "prj_10": PRJ_10,
    "prj_11": "SELECT doc_id, md5(regexp_replace(text, '[^\\x20-\\x7e]', '.', 'g')) AS printable FROM documents",
    "prj_15": f"{H} SELECT page_id, least(ip || ':25', '10.0.0.20:993') || '|' || greatest(ip || ':25', '10.0.0.20:993') AS flow FROM h",
    "srt_02": f"{H} SELECT DISTINCT ip, port, host FROM i",
    "str_01": f"{O} SELECT k, {PROTO('u', chr(39) * 2)} AS by_server, {PROTO(chr(39) * 2, 'u')} AS by_client FROM u",
    "str_02": f"{O}, p AS (SELECT k, {PROTO('u', chr(39) * 2)} AS p FROM u) SELECT k, CASE WHEN k % 6 = 0 THEN 'imap' ELSE coalesce(p, 'unknown') END AS protocol, CASE WHEN k % 6 = 0 THEN 'INFERRED' WHEN p IS NOT NULL THEN 'OBSERVED' ELSE 'NOT_OBSERVABLE' END AS tier FROM p",
    "str_03": f"{D} SELECT doc_id, n, start, CAST(length(line) AS INTEGER) AS size, md5(line) AS line FROM l",
    "str_04": f"{O} SELECT k, kind FROM u WHERE (kind = 'smtp' AND regexp_matches(u, '^AUTH{END}')) OR (kind = 'imap' AND regexp_matches(u, '^[^ \\t\\r\\n]+[ \\t]+AUTHENTICATE{END}')) OR (kind = 'pop3' AND regexp_matches(u, '^(AUTH|USER|PASS){END}'))",
    "str_05": f"{O} SELECT k, CASE WHEN kind = 'smtp' AND regexp_matches(u, '^STARTTLS{END}') THEN 'STARTTLS' WHEN kind = 'imap' AND regexp_matches(u, '^[^ \\t\\r\\n]+[ \\t]+STARTTLS{END}') THEN 'STARTTLS' WHEN kind = 'pop3' AND regexp_matches(u, '^STLS{END}') THEN 'STLS' END AS request FROM u",
    "str_06": f"""{O} SELECT k, CASE kind
        WHEN 'smtp' THEN CASE WHEN regexp_matches(u, '^220([ -]|\\r?\\n)') THEN 'accepted' WHEN regexp_matches(u, '^5\\d\\d([ -]|\\r?\\n)') THEN 'rejected' WHEN regexp_matches(u, '^\\d\\d\\d([ -]|\\r?\\n)') THEN 'other' END
        WHEN 'imap' THEN CASE WHEN regexp_matches(line, '^a2[ \\t]+(?i:OK){END}') THEN 'accepted' WHEN regexp_matches(line, '^a2[ \\t]+(?i:NO|BAD){END}') THEN 'rejected' END
        WHEN 'pop3' THEN CASE WHEN u LIKE '+OK%' THEN 'accepted' WHEN u LIKE '-ERR%' THEN 'rejected' END END AS status FROM u""",
    "str_07": f"{O} SELECT k, w AS word, length(w) = 8 AND regexp_matches(w, '^[A-Z]+$') AND w NOT IN ('STARTTLS', 'CHUNKING', 'SMTPUTF8') AS suspicious FROM (SELECT k, regexp_extract(u, '^250[ -]([^ \\t\\r\\n]+)', 1) AS w FROM u) WHERE w <> ''",
    "str_08": f"{H} SELECT page_id, lower(rtrim(banner, '.')) AS host FROM h",
    "str_09": f"{O} SELECT k, CASE k % {len(SAMPLES)} WHEN 0 THEN 'mx.example.com' WHEN 1 THEN 'mail.example.org' END AS host FROM o",
    "str_10": f"{H} SELECT page_id, host, source FROM i",
    "str_11": "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS ref FROM part",
    "str_14": f"SELECT event_id, {FILT('user_id', 'event_id')} AS filter FROM events",
    "win_09": f"{D}, c AS (SELECT doc_id, min(n) AS cut FROM l WHERE regexp_matches(line, '(?i)the that') GROUP BY doc_id) SELECT doc_id, count(*) AS n FROM l LEFT JOIN c USING (doc_id) WHERE cut IS NULL OR n <= cut GROUP BY doc_id",
}
