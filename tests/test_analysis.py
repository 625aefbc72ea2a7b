"""Certificates, isolation and the whole way from captures to reports, on captures built by hand."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from test_captures import CLIENT, SERVER, ethernet, extension, hello, pcap, record, tcp

from wirepost.functions import conditions, der, registry, tls
from wirepost.functions.tracking import Budget
from wirepost.operators import analysis, certificates, findings, forest, windows
from wirepost.sources import captures


def test_names_of_suites_say_what_they_are():
    assert len(registry.SUITES) == 36 and len(registry.GROUPS) == 10
    assert registry.algorithms(0xC02F) == [("ECDHE", "key-agree", None), ("RSA", "signature", None), ("AES-128-GCM", "ae", "gcm")]
    assert registry.algorithms(0x000A) == [("RSA", "pke", None), ("3DES-EDE-CBC", "block-cipher", "cbc")]
    assert registry.algorithms(0x1303) == [("ChaCha20-Poly1305", "ae", None)] and registry.algorithms(0x0005)[1] == ("RC4-128", "stream-cipher", None)
    assert registry.algorithms(0xCCAA)[2] == ("ChaCha20-Poly1305", "ae", None) and registry.algorithms(0x5600) == []
    props = {c: registry.properties(c) for c in registry.SUITES}
    assert {c for c, p in props.items() if p["static_kex"]} == {0x0005, 0x000A, 0x002F, 0x0035, 0x003C, 0x003D, 0x009C, 0x009D}
    assert {c for c, p in props.items() if p["tls13"]} == {0x1301, 0x1302, 0x1303} and sum(p["cbc"] for p in props.values()) == 19


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = b""
    for n in (40 * first + second, *rest):
        part = bytes([n & 127])
        while n := n >> 7:
            part = bytes([128 | n & 127]) + part
        out += part
    return tlv(6, out)


def name(text):
    return tlv(0x30, tlv(0x31, tlv(0x30, oid("2.5.4.3"), tlv(0x0C, text.encode()))))


def rsa_key(bits):
    modulus = b"\0" + (1 << (bits - 1) | 1).to_bytes(bits // 8, "big")
    return tlv(0x30, tlv(0x30, oid(der.RSA), tlv(5)), tlv(3, b"\0", tlv(0x30, tlv(2, modulus), tlv(2, b"\1\0\1"))))


def ec_key(curve):
    return tlv(0x30, tlv(0x30, oid(der.EC), oid(curve)), tlv(3, b"\0\4" + b"x" * 64))


def cert(issuer="a", subject="b", start="240101000000Z", end="260101000000Z", key=None, signature="1.2.840.113549.1.1.11", version=True):
    parts = [tlv(0xA0, tlv(2, b"\2"))] * version + [tlv(2, b"\1"), tlv(0x30, oid(signature), tlv(5)), name(issuer), tlv(0x30, *(tlv(0x17 if len(t) == 13 else 0x18, t.encode()) for t in (start, end))), name(subject), key or rsa_key(2048)]
    return tlv(0x30, tlv(0x30, *parts), tlv(0x30, oid(signature), tlv(5)), tlv(3, b"\0sig"))


def test_certificate_fields():
    whole = der.certificate(cert())
    at = lambda *x: datetime(*x, tzinfo=UTC).timestamp()
    assert (whole["status"], whole["not_before"], whole["not_after"], whole["self_signed"]) == ("complete", at(2024, 1, 1), at(2026, 1, 1), False)
    assert (whole["signature_hash"], whole["key_kind"], whole["key_bits"], whole["key_strength"], whole["weak"]) == ("sha256", "RSA", 2048, "VALID", None)
    assert der.certificate(cert(issuer="b", version=False))["self_signed"]
    weak = der.certificate(cert(key=rsa_key(1024), start="19491231235959Z", end="500101000000Z"))
    assert (weak["key_bits"], weak["key_strength"], weak["weak"]) == (1024, "INVALID", "weak key (RSA, 1024 bits; minimum 2048)")
    assert (weak["not_before"], weak["not_after"]) == (at(1949, 12, 31, 23, 59, 59), at(1950, 1, 1))
    curve = der.certificate(cert(key=ec_key("1.3.132.0.34"), signature="1.2.840.10045.4.3.3"))
    assert (curve["key_kind"], curve["key_bits"], curve["curve"], curve["signature_hash"]) == ("EC", 384, "secp384r1", "sha384")
    edwards = der.certificate(cert(key=tlv(0x30, tlv(0x30, oid("1.3.101.112")), tlv(3, b"\0" + b"k" * 32)), signature="1.3.101.112"))
    assert (edwards["key_kind"], edwards["key_bits"], edwards["signature_hash"], edwards["key_strength"]) == ("Ed25519", None, None, "VALID")
    odd = der.certificate(cert(key=tlv(0x30, tlv(0x30, oid("1.2.3")), tlv(3, b"\0"))))
    assert (odd["status"], odd["key_kind"], odd["key_strength"]) == ("complete", None, "NOT_OBSERVABLE")


def test_certificates_that_are_cut_or_changed():
    whole, rng = cert(), np.random.default_rng(5)
    assert {der.certificate(whole[:n])["status"] for n in range(len(whole))} == {"malformed"}
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.integers(1, 4)):
            data[rng.integers(len(data))] = rng.integers(256)
        assert der.certificate(bytes(data))["status"] in ("complete", "malformed")


def test_certificate_verdicts(spark):
    t = datetime(2025, 1, 1, tzinfo=UTC).timestamp()
    rows = [(1, cert(), t, False), (2, cert(end="240601000000Z"), t, False), (3, cert(issuer="b"), None, False), (4, None, t, True), (5, None, t, False), (6, b"junk", t, False), (7, cert(), None, False)]
    got = certificates.certificate_verdicts(certificates.certificate_fields(spark.createDataFrame(rows, "k int, der binary, ts double, newest boolean")), "ts", "newest")
    told = {r.k: (r.cert_status, r.cert_reason) for r in got.collect()}
    assert told[1] == ("VALID", None) and told[2] == ("INVALID", "expired at capture time") and told[3] == ("INVALID", "self-signed; capture time unknown")
    assert told[4][0] == told[5][0] == "NOT_OBSERVABLE" and "TLS 1.3" in told[4][1] and told[6] == ("INDETERMINATE", "certificate DER could not be parsed")
    assert told[7] == ("INDETERMINATE", "capture time unknown")


def test_isolation_finds_what_stands_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(600)] + [(1000, [9.0] * 4), (1001, [-8.0, 0.0, 8.0, None])]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    trees = forest.forest(df)
    scores = {r.id: r.isolation for r in forest.isolation(df, trees).collect()}
    assert len(trees) == 200 and len(scores) == 602 and all(0 < x < 1 for x in scores.values())
    assert sorted(scores, key=scores.get)[-2:] in ([1000, 1001], [1001, 1000])
    again = {r.id: r.isolation for r in forest.isolation(df.repartition(5), forest.forest(df.repartition(5))).collect()}
    assert again == scores
    assert {r.isolation for r in forest.isolation(df, []).collect()} == {0.0}
    same = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id long, features array<double>")
    assert len({r.isolation for r in forest.isolation(same, forest.forest(same)).collect()}) == 1


def test_conditions_are_closed(spark):
    rows = spark.createDataFrame([(1, "x", [1])], "n int, s string, a array<int>")
    met = lambda text: rows.where(conditions.condition(text, rows.schema)).count() == 1
    assert met("n == 0x1") and met("n >= 1.0") and met("s == 'x'") and met("a is not empty") and met("n == true") and met('s != "1"')
    assert not met("s < 2") and not met("gone == 1") and met("gone is null") and not met("n != 1") and met("n != null") and not met("n == null")
    for text in ("", "n", "n = 1", "n == 1 and n == 2", "1 == n", "n =="):
        with pytest.raises(ValueError, match="condition|missing"):
            conditions.condition(text, rows.schema)
    with pytest.raises(Exception, match="no known reason"):
        bad = spark.sql("SELECT map('f', 'NOT_OBSERVABLE') AS t, map('f', 'because') AS r")
        bad.select(findings.reason_codes(bad.t, bad.r, bad.r.isNull())).collect()


OFFER = extension(43, b"\4\3\4\3\3") + extension(10, b"\0\4\x11\xec\0\x1d") + extension(5, b"\1\0\0\0\0")
HELLO = hello(1, b"r" * 32, b"\0\4\x13\1\xc0\x2f\1\0", OFFER)


def certificate_message(data):
    return b"\x0b" + (len(data) + 6).to_bytes(3, "big") + (len(data) + 3).to_bytes(3, "big") + len(data).to_bytes(3, "big") + data


def conversation(server, *turns):
    """Frames of a conversation: (from the client?, payload), sequence numbers counted from 1."""
    client, seq = ("10.0.0.9", 40000 + server[1]), [1, 1]
    out = [ethernet(tcp(client, server, 0, b"", 2)), ethernet(tcp(server, client, 0, b"", 18))]
    for up, payload in turns:
        a, b = (client, server) if up else (server, client)
        out.append(ethernet(tcp(a, b, seq[not up], payload)))
        seq[not up] += len(payload)
    return out


def test_from_captures_to_reports(spark):
    up, down = lambda x: (True, x), lambda x: (False, x)
    old = hello(2, b"r" * 24 + bytes.fromhex("444F574E47524401"), b"\xc0\x2f\0", b"")
    new = hello(2, b"s" * 32, b"\x13\1\0", extension(43, b"\3\4") + extension(51, b"\x11\xec\0\0"))
    mail = ("10.0.0.2", 25)
    upgraded = conversation(mail, down(b"220 mx ESMTP\r\n"), up(b"EHLO c\r\n"), down(b"250-mx\r\n250 STARTTLS\r\n"), up(b"STARTTLS\r\n"), down(b"220 go\r\n"), up(record(HELLO)), down(record(old) + record(certificate_message(cert(issuer="b", end="700101000000Z")))))
    clear = conversation(("10.0.0.3", 25), down(b"220 mx ESMTP\r\n"), up(b"EHLO c\r\n"), down(b"250 mx\r\n"), up(b"AUTH PLAIN abc\r\n"), down(b"235 ok\r\n"), up(b"DATA\r\n"), down(b"354\r\n"), up(b"STARTTLS\r\n.\r\n"))
    hidden = conversation(("10.0.0.4", 993), up(record(HELLO)), down(record(new)))
    web = conversation(("10.0.0.5", 80), up(b"GET / HTTP/1.1\r\n"), down(b"HTTP/1.1 200 OK\r\n"))
    mailbox = conversation(("10.0.0.6", 110), down(b"+OK hi\r\n"), up(b"STLS\r\n"), down(b"-ERR no\r\n"), up(b"USER a\r\n"), down(b"+OK\r\n"))
    captures_ = spark.createDataFrame([("one", pcap(upgraded + clear + hidden + web + mailbox)), ("two", pcap(clear)), ("none", b"junk")], "capture string, content binary")
    found = analysis.analyse(captures_)
    rows = {(r.capture, r.flow.split("|")[1 if "10.0.0.9" not in r.flow.split("|")[1] else 2]): r for r in found.sessions.collect()}
    one = {k[1]: r for k, r in rows.items() if k[0] == "one"}
    assert set(one) == {"10.0.0.2:25", "10.0.0.3:25", "10.0.0.4:993", "10.0.0.6:110"}
    a, b, c, d = (one[k] for k in sorted(one))
    assert (a.protocol, a.verdict, a.version, a.offered_version, a.delta, a.cipher) == ("smtp", "upgraded", "TLS1.2", "TLS1.3", 1, "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256")
    assert (a.cert_status, a.cert_reason.split(";")[0], a.downgrade_anomaly, a.auth_cleartext) == ("INVALID", "expired at capture time", True, False)
    assert (b.protocol, b.verdict, b.auth_cleartext, b.starttls_offered, b.version) == ("smtp", "not_used", True, False, None)
    assert (c.protocol, c.protocol_tier, c.verdict, c.version, c.key_group, c.hybrid, c.cert_status) == ("imap", "INFERRED", "upgraded", "TLS1.3", "X25519MLKEM768", True, "NOT_OBSERVABLE")
    assert (d.protocol, d.verdict, d.auth_cleartext) == ("pop3", "rejected", True)
    rules = {}
    for f in found.findings.collect():
        rules.setdefault(f.session, set()).add(f.rule)
    assert rules[a.session] == {"TLS-DOWNGRADE-ANOMALY", "TLS-NO-OCSP-STAPLING", "CERT-EXPIRED", "CERT-SELF-SIGNED"}
    assert rules[b.session] == {"CLEARTEXT-AUTH", "STARTTLS-NOT-OFFERED"} and rules[c.session] == {"PQ-HYBRID-OBSERVED"} and rules[d.session] == {"CLEARTEXT-AUTH"}
    assert b.observed_risk >= 90 and b.risk_band == "critical" and c.observed_risk == 0 and 0 < a.observed_risk < 90
    reports = {r.capture: json.loads(r.report) for r in found.reports.collect()}
    one_report = reports["one"]
    assert one_report["summary"] == {"cleartext": 2, "encrypted": 2, "findings_assessed": True, "findings_by_severity": {"critical": 2, "high": 3, "info": 1, "low": 1, "medium": 1}, "not_observable": 0, "sessions_total": 4}
    assert one_report["hndl"] == {"exposed_sessions": 3, "percent": 75, "quantum_safe_sessions": 1, "total_sessions": 4, "unobservable_sessions": 0}
    assert [s["server_name"] for s in one_report["sessions"]] == ["mx@10.0.0.2:25", "mx@10.0.0.3:25", "10.0.0.4:993", "10.0.0.6:110"] and len(one_report["findings"]) == 8
    assert one_report["capture_health"]["analysis_status"] == "complete" and {s["server"] for s in one_report["servers"]} == {"mx@10.0.0.2:25", "mx@10.0.0.3:25", "10.0.0.4:993", "10.0.0.6:110"}
    assert reports["two"]["summary"]["sessions_total"] == 1 and reports["none"]["summary"]["sessions_total"] == 0 and set(reports) == {"one", "two", "none"}
    assert not reports["none"]["summary"]["findings_assessed"]
    assert {r.capture: r.analysis_status for r in found.health.collect()} == {"one": "complete", "two": "complete", "none": "unreadable"}
    shown = windows.evidence_windows(found.findings.where("capture = 'one'"), captures.segments(captures.frames(captures_))).collect()
    assert {r.ascii for r in shown if r.rule == "CLEARTEXT-AUTH"} == {"AUTH PLAIN [REDACTED]"} and not any("abc" in r.ascii for r in shown)
    assert {(r.ascii, r.withheld) for r in shown if r.rule == "STARTTLS-NOT-OFFERED"} == {("250", 5)} and {r.hex for r in shown if r.rule == "PQ-HYBRID-OBSERVED"} == {""}
    inventories = {r.capture: json.loads(r.document) for r in found.inventories.collect()}
    assert set(inventories) == {"one"}
    parts = {c["bom-ref"]: c for c in inventories["one"]["components"]}
    assert {r for r in parts if "protocol" in r} == {"crypto/protocol/TLS-1.2@mx@10.0.0.2:25", "crypto/protocol/TLS-1.3@10.0.0.4:993"}
    old_tls = parts["crypto/protocol/TLS-1.2@mx@10.0.0.2:25"]
    assert [x["identifiers"] for x in old_tls["cryptoProperties"]["protocolProperties"]["cipherSuites"]] == [["0xC0", "0x2F"]] and old_tls["evidence"]["occurrences"][0]["location"] == "frame 9"
    assert parts["crypto/algorithm/X25519MLKEM768-kem"]["cryptoProperties"]["algorithmProperties"]["nistQuantumSecurityLevel"] == 3
    assert {e["ref"]: e["provides"] for e in inventories["one"]["dependencies"]}["crypto/protocol/TLS-1.3@10.0.0.4:993"] == ["crypto/algorithm/AES-128-GCM-ae"]
    packets, proof = upgraded + clear + hidden + web + mailbox, {}
    for f in found.findings.where("capture = 'one'").collect():
        assert f.tier == "OBSERVED" and f.evidence and f.reason is None
        proof[f.session, f.rule] = [packets[e.frame - 1][e.offset : e.offset + e.length] for e in f.evidence]
    assert proof[b.session, "CLEARTEXT-AUTH"] == [b"AUTH PLAIN abc\r\n"] and proof[b.session, "STARTTLS-NOT-OFFERED"] == [b"250 mx\r\n"]
    assert proof[d.session, "CLEARTEXT-AUTH"] == [b"USER a\r\n"] and proof[c.session, "PQ-HYBRID-OBSERVED"] == [b"\x11\xec"]
    assert proof[a.session, "TLS-DOWNGRADE-ANOMALY"] == [b"\3\4\3\3", bytes.fromhex("444F574E47524401")]
    assert proof[a.session, "CERT-EXPIRED"] == [cert(issuer="b", end="700101000000Z")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from wirepost import __main__ as command

    clear = conversation(("10.0.0.3", 25), (False, b"220 mx ESMTP\r\n"), (True, b"EHLO c\r\n"), (False, b"250 mx\r\n"), (True, b"AUTH PLAIN abc\r\n"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(pcap(clear))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    for more in ([], ["--ranges"]):
        monkeypatch.setattr("sys.argv", ["wirepost", str(tmp_path / "in"), *more])
        command.main()
        told = json.loads(capsys.readouterr().out)
        assert told["summary"]["cleartext"] == 1 and told["observed_risk"] == 90
    monkeypatch.setattr("sys.argv", ["wirepost", str(tmp_path / "in"), str(tmp_path / "out")])
    command.main()
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"reports", "servers", "sessions", "findings"} | ({"inventories"} if (tmp_path / "out" / "inventories").exists() else set())
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).count() == 2


def sessions_of(spark, *conversations):
    packets = [p for c in conversations for p in c]
    found = analysis.analyse(spark.createDataFrame([("c", pcap(packets))], "capture string, content binary"))
    return found, sorted(found.sessions.collect(), key=lambda r: r.first_frame)


def test_what_a_server_selected(spark):
    """Draft and old versions, suites that no table knows, broken and inconsistent ServerHellos."""
    up, down = lambda x: (True, x), lambda x: (False, x)
    versions = lambda *v: extension(43, bytes([2 * len(v)]) + b"".join(x.to_bytes(2, "big") for x in v))
    client = lambda exts, legacy=b"\3\3": (lambda h: h[:4] + legacy + h[6:])(hello(1, b"r" * 32, b"\0\4\x13\1\xc0\x2f\1\0", exts))
    server = lambda suite, exts=b"", random=b"s" * 32, legacy=b"\3\3": (lambda h: h[:4] + legacy + h[6:])(hello(2, random, suite + b"\0", exts))
    new = extension(43, b"\3\4") + extension(51, b"\0\x1d\0\0")
    retry = server(b"\x13\2", extension(43, b"\3\4") + extension(51, b"\0\x1d"), random=tls.RETRY)
    cases = [
        (client(versions(0x7F1C, 0x0303)), server(b"\0\x9e")),
        (client(b"", b"\3\0"), server(b"\0\x2f", legacy=b"\3\0")),
        (client(versions(0x0304, 0x0303)), server(b"\xab\xcd", legacy=b"\3\1")),
        (client(versions(0x0304)), server(b"\x13\1", extension(43, b"\3\3"))),
        (client(versions(0x0304)), retry, server(b"\x13\1", new)),
        (client(versions(0x0304)), retry, server(b"\x13\2", new)),
        (client(versions(0x0304)),),
    ]
    made = [conversation((f"10.0.1.{i}", 993), up(record(c[0])), *(down(record(x)) for x in c[1:])) for i, c in enumerate(cases)]
    _, rows = sessions_of(spark, *made)
    told = [(r.version, r.delta, r.cipher, r.cipher_known, r.version_tier, r.cipher_tier) for r in rows]
    seen, hidden = "OBSERVED", "NOT_OBSERVABLE"
    assert told == [
        ("TLS1.2", 0, "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256", True, seen, seen),
        ("SSL3.0", None, "TLS_RSA_WITH_AES_128_CBC_SHA", True, seen, seen),
        ("TLS1.0", 3, "UNKNOWN_0xABCD", False, seen, seen),
        (None, None, None, False, hidden, hidden),
        (None, None, None, False, hidden, hidden),
        ("TLS1.3", 0, "TLS_AES_256_GCM_SHA384", True, seen, seen),
        (None, None, None, False, hidden, hidden),
    ]
    assert [r.offered_version for r in rows] == [None, "SSL3.0", "TLS1.3", "TLS1.3", "TLS1.3", "TLS1.3", "TLS1.3"]


def test_a_server_that_contradicts_itself(spark):
    """The same server takes TLS 1.3 once and passes over it another time; who asked for a name lends it to who didn't."""
    up, down = lambda x: (True, x), lambda x: (False, x)
    name = extension(0, b"\0\7\0\0\4mx.a")
    offer = extension(43, b"\4\3\4\3\3") + extension(51, b"\0\0")
    ask = lambda extra: hello(1, b"r" * 32, b"\0\4\x13\1\xc0\x2f\1\0", extra + offer)
    new = hello(2, b"s" * 32, b"\x13\1\0", extension(43, b"\3\4") + extension(51, b"\0\x1d\0\0"))
    old = hello(2, b"s" * 32, b"\xc0\x2f\0", b"")
    one = conversation(("10.0.0.4", 993), up(record(ask(name))), down(record(new)))
    two = conversation(("10.0.0.4", 993), up(record(ask(b""))), down(record(old) + record(certificate_message(cert()))))
    two = [p.replace((40993).to_bytes(2, "big"), (41000).to_bytes(2, "big")) for p in two]
    found, (a, b) = sessions_of(spark, one, two)
    assert (a.server_name, a.host_source, a.host_tier) == ("mx.a@10.0.0.4:993", "tls_sni", "OBSERVED")
    assert (b.server_name, b.host_source, b.host_tier) == ("mx.a@10.0.0.4:993", "endpoint_sni_association", "DEDUCED")
    (server,) = found.servers.collect()
    assert server.contradictions == ["version:0x0304"] and server.n_sessions == 2
    told = {f.session: f for f in found.findings.where("rule = 'SERVER-INCONSISTENT'").collect()}
    packets = one + two
    assert set(told) == {a.session, b.session} and {f.tier for f in told.values()} == {"DEDUCED"}
    assert sorted(packets[e.frame - 1][e.offset : e.offset + e.length] for e in told[a.session].evidence) == [b"\3\4", b"\3\4"]
    assert len({e.frame for e in told[a.session].evidence}) == 2
    (hidden,) = found.sessions.where("fingerprints IS NOT NULL").collect()
    assert hidden.session == a.session and hidden.fingerprints == [b.certificate_sha256] and not hidden.ambiguous


def test_openings_across_segments(spark):
    """Candidates by first bytes that come in pieces and out of order, also before what comes earlier in the stream."""
    from wirepost.operators import flows, reassembly

    c, s = ("10.0.0.9", 40000), lambda i: (f"10.0.2.{i}", 8080)
    sent = [[(1, b"2"), (2, b"20 hi")], [(3, b"0 hi"), (1, b"22")], [(10, b"220 "), (5, b"x")], [(1, b"22"), (4, b" ")], [(1, b"+"), (1, b"-"), (2, b"OK")], [(1, b"-"), (1, b"+OK")], [(1, b"\x16"), (2, b"\3")], [(1, b"HTTP")]]
    packets = [ethernet(tcp(s(i), c, seq, data)) for i, parts in enumerate(sent) for seq, data in parts]
    segments = captures.segments(captures.frames(spark.createDataFrame([("c", pcap(packets))], "capture string, content binary")))
    rows = flows.stream_segments(flows.generations(segments))
    got = {r.flow.split("10.0.2.")[1][0] for r in reassembly.candidates(rows, analysis.PREFIXES).collect()}
    assert got == set("012") | {"4", "6"}


def test_budget_leaves_flows_incomplete(spark):
    up, down = lambda x: (True, x), lambda x: (False, x)
    long = conversation(("10.0.0.2", 25), down(b"220 mx ESMTP\r\n"), up(b"EHLO c\r\n"), down(b"250 mx\r\n"), up(b"AUTH PLAIN abc\r\n"))
    packets = spark.createDataFrame([("c", pcap(long))], "capture string, content binary")
    whole = analysis.analyse(packets).sessions.first()
    cut = analysis.analyse(packets, Budget(each=25)).sessions.first()
    assert (whole.auth_cleartext, whole.incomplete) == (True, False) and (cut.auth_cleartext, cut.incomplete) == (False, True)
