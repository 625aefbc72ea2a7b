"""What of the bytes that a finding cites may be shown: decided by the field and the span's own grammar, never beyond the span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mail

#: Fields of public handshake framing, shown whole.
PUBLIC = (
    "tls.record", "tls.certificate", "tls.client_hello.legacy_version", "tls.client_hello.supported_versions", "tls.client_hello.supported_version", "tls.client_hello.cipher_suites",
    "tls.client_hello.extension_type", "tls.client_hello.server_name", "tls.server_hello.version", "tls.server_hello.cipher_suite", "tls.server_hello.extension_type", "tls.server_hello.random.downgrade_sentinel",
)
#: Fields of one word, shown if it still is one.
TOKENS = {"smtp.capability": "[A-Z][A-Z0-9-]{0,31}", "smtp.banner.hostname": "[A-Za-z0-9]([A-Za-z0-9.-]{0,252}[A-Za-z0-9])?"}
#: What a line may begin with and show: status codes and commands without arguments.
PREFIX = r"(?i)^([2-5]\d\d(?=[ \t\r\n-]|$)|(?:\+OK|-ERR|EHLO|HELO|LHLO|STARTTLS|STLS|CAPA|QUIT|NOOP|RSET|DATA)(?=[ \t\r\n]|$))"
#: What stands for bytes that aren't shown.
HIDDEN = {"login": "AUTH PLAIN [REDACTED]", "key": "TLS key-share [not displayed]", "elsewhere": "[evidence bytes not displayed]", "text": "[protocol text not displayed]"}


def window(rule: Column, field: Column, payload: Column, start: Column, length: Column) -> Column:
    """struct(hex, ascii, withheld) of a cited span of a payload (ISO-8859-1 text, a character a byte).

    Logins and key shares are never shown, nor a span that isn't inside the payload. Framing is shown whole, a field of one
    word if it is one, of a line that begins where a line begins its status code or command.
    """
    span = F.substring(payload, start + 1, length)
    inside = (start >= 0) & (start <= F.length(payload)) & (F.length(span) == length)
    token = F.coalesce(*(F.when(field == name, span.rlike(f"\\A{pattern}\\z")) for name, pattern in TOKENS.items()), F.lit(False))
    fresh = (start == 0) | (F.substring(payload, start, F.lit(1)) == "\n")
    prefix = F.when((field == "protocol.line") & fresh, F.regexp_extract(span, PREFIX, 1)).otherwise("")
    why = (
        F.when((field == "cleartext-auth") | (rule == "CLEARTEXT-AUTH"), HIDDEN["login"])
        .when(field.contains("key_share"), HIDDEN["key"])
        .when(~inside, HIDDEN["elsewhere"])
        .when(field.isin(*PUBLIC) | token, None)
        .when(prefix != "", None)
        .otherwise(HIDDEN["text"])
    )
    shown = F.when(why.isNotNull(), "").when(field.isin(*PUBLIC) | token, span).otherwise(prefix)
    hexed = F.regexp_replace(F.lower(F.hex(F.encode(shown, "ISO-8859-1"))), "(..)(?!$)", "$1 ")
    return F.struct(hexed.alias("hex"), F.coalesce(why, mail.printable(shown)).alias("ascii"), (length - F.length(shown)).cast("long").alias("withheld"))


def evidence_windows(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """(capture, session, rule, frame, field, offset, length, hex, ascii, withheld): the window of each piece of evidence of
    findings (capture, session, rule, evidence), out of segments (capture, frame, payload, payload_off)."""
    each = findings.select("capture", "session", "rule", F.explode("evidence").alias("e")).select("capture", "session", "rule", "e.*")
    sent = segments.where("payload IS NOT NULL").select(F.col("capture").alias("capture_"), F.col("frame").alias("frame_"), "payload", "payload_off")
    met = each.join(sent, (F.col("capture") == F.col("capture_")) & (F.col("frame") == F.col("frame_")), "left")
    text = F.coalesce(F.decode("payload", "ISO-8859-1"), F.lit(""))
    shown = window(F.col("rule"), F.col("field"), text, (F.col("offset") - F.coalesce("payload_off", F.lit(0))).cast("int"), F.col("length").cast("int"))
    return met.select("capture", "session", "rule", "frame", "field", "offset", "length", shown.alias("w")).select("capture", "session", "rule", "frame", "field", "offset", "length", "w.*")
