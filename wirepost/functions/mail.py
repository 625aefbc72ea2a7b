"""Mail grammar as columns over lines of text: protocols, requests, replies, capabilities, names, redaction.

Captured bytes are read as ISO-8859-1, so a character is a byte; only ASCII letters change case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of the public registry of SMTP service extensions that have eight letters and nothing else.
EIGHT_LETTERS = ("CHUNKING", "STARTTLS")
#: What a line begins with, in upper case, and what that means, by protocol; the first meaning counts.
END, TAG = r"([ \t]|\r?\n)", r"[^ \t\r\n]+[ \t]+"
GRAMMAR = [
    ("smtp", "auth", f"AUTH{END}"),
    ("smtp", "STARTTLS", f"STARTTLS{END}"),
    ("smtp", "accepted", r"220([ -]|\r?\n)"),
    ("smtp", "rejected", r"5\d\d([ -]|\r?\n)"),
    ("smtp", "other", r"\d{3}([ -]|\r?\n)"),
    ("imap", "auth", f"{TAG}AUTHENTICATE{END}"),
    ("imap", "STARTTLS", f"{TAG}STARTTLS{END}"),
    ("imap", "accepted", f"{TAG}OK{END}"),
    ("imap", "rejected", f"{TAG}(NO|BAD){END}"),
    ("pop3", "auth", f"(AUTH|USER|PASS){END}"),
    ("pop3", "STLS", f"STLS{END}"),
    ("pop3", "accepted", r"\+OK"),
    ("pop3", "rejected", r"-ERR"),
]
#: How either side opens, in upper case; the first protocol that fits counts.
OPENINGS = [
    ("smtp", "server", r"220[ -][^\n]*SMTP"),
    ("smtp", "client", r"EHLO "),
    ("imap", "server", r"\* (OK|PREAUTH)"),
    ("pop3", "server", r"\+OK"),
]
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper_ascii(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def meaning(line: Column, kind: Column, *wanted: str) -> Column:
    """Which of the wanted meanings GRAMMAR gives a line of that protocol; null if none."""
    text = upper_ascii(line)
    return F.coalesce(*(F.when((kind == p) & text.rlike(f"^{pattern}"), m) for p, m, pattern in GRAMMAR if m in wanted))


def protocol(server: Column, client: Column) -> Column:
    """smtp, imap, pop3 or null, by the opening grammar of either side."""
    text = {"server": upper_ascii(server), "client": upper_ascii(client)}
    return F.coalesce(*(F.when(text[side].rlike(f"^{pattern}"), p) for p, side, pattern in OPENINGS))


def classified(cleartext: Column, tls_first: Column, port_hint: Column) -> Column:
    """struct(protocol, tier): implicit TLS on a known port is inferred, grammar observed, all else not observable."""
    implicit = tls_first & port_hint.isNotNull()
    name = F.when(implicit, port_hint).otherwise(F.coalesce(cleartext, F.lit("unknown")))
    tier = F.when(implicit, "INFERRED").when(cleartext.isNotNull(), "OBSERVED").otherwise("NOT_OBSERVABLE")
    return F.struct(name.alias("protocol"), tier.alias("tier"))


def is_auth(line: Column, kind: Column) -> Column:
    return meaning(line, kind, "auth").isNotNull()


def request_kind(line: Column, kind: Column) -> Column:
    return meaning(line, kind, "STARTTLS", "STLS")


def reply_status(line: Column, kind: Column, tag: Column) -> Column:
    """accepted, rejected, other or null if the line is no reply to the request; only IMAP replies name their request's tag."""
    own = (kind != "imap") | (F.substring_index(F.regexp_replace(line, r"[ \t\r\n]", " "), " ", 1) == tag)
    return F.when(own, meaning(line, kind, "accepted", "rejected", "other"))


def capability(line: Column) -> Column:
    """The word of an SMTP 250 line; empty if it is none."""
    return F.regexp_extract(upper_ascii(line), r"^250[ -]([^ \t\r\n]+)", 1)


def suspicious_capability(word: Column) -> Column:
    return word.rlike("^[A-Z]{8}$") & ~word.isin(*EIGHT_LETTERS)


def hostname(value: Column) -> Column:
    """A host name without closing dots, in lower case; null if it breaks the grammar of labels."""
    name = lower_ascii(F.regexp_replace(value, r"\.+$", ""))
    good = (F.length(name) > 0) & (F.length(name) <= 253) & F.forall(F.split(name, r"\."), lambda x: x.rlike("^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"))
    return F.when(good, name)


def banner_host(line: Column) -> Column:
    return hostname(F.regexp_extract(line, r"^220[ -](\S+)", 1))


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip), F.lit(":"), port.cast("string"))


def server_id(host: Column, at: Column) -> Column:
    return F.coalesce(F.concat(host, F.lit("@"), at), at)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7e]", ".")


def display_filter(stream: Column, frame: Column) -> Column:
    """tcp.stream eq N && frame.number == M; parts that aren't non-negative integers are left out."""
    part = lambda text, c: F.when(c >= 0, F.concat(F.lit(text), c.cast("string")))
    return F.concat_ws(" && ", part("tcp.stream eq ", stream), part("frame.number == ", frame))


def slug(name: Column) -> Column:
    return F.regexp_replace(lower_ascii(name), "[^a-z0-9]+", "-")
