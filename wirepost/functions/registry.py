"""Code points of public registries, and what their names say of them."""

from __future__ import annotations

import re

#: Versions by code point, and their places in the order of age; older ones than TLS 1.0 have none.
VERSIONS = {0x0300: "SSL3.0", 0x0301: "TLS1.0", 0x0302: "TLS1.1", 0x0303: "TLS1.2", 0x0304: "TLS1.3"}
ORDINALS = {0x0301: 1, 0x0302: 2, 0x0303: 3, 0x0304: 4}
#: Suites that have names here.
SUITES = {
    0x0005: "TLS_RSA_WITH_RC4_128_SHA",
    0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA",
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA",
    0x0033: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA",
    0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA",
    0x0039: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA",
    0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256",
    0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256",
    0x0067: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256",
    0x006B: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256",
    0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384",
    0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256",
    0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384",
    0x00FF: "TLS_EMPTY_RENEGOTIATION_INFO_SCSV",
    0x1301: "TLS_AES_128_GCM_SHA256",
    0x1302: "TLS_AES_256_GCM_SHA384",
    0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0x5600: "TLS_FALLBACK_SCSV",
    0xC008: "TLS_ECDHE_ECDSA_WITH_3DES_EDE_CBC_SHA",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA",
    0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    0xC012: "TLS_ECDHE_RSA_WITH_3DES_EDE_CBC_SHA",
    0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA",
    0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256",
    0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384",
    0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256",
    0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCAA: "TLS_DHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
}
#: Groups: name and class.
GROUPS = {
    0x0017: ("secp256r1", "CLASSICAL"),
    0x0018: ("secp384r1", "CLASSICAL"),
    0x001D: ("x25519", "CLASSICAL"),
    0x001E: ("x448", "CLASSICAL"),
    0x0100: ("ffdhe2048", "CLASSICAL"),
    0x11EB: ("SecP256r1MLKEM768", "PQ_HYBRID"),
    0x11EC: ("X25519MLKEM768", "PQ_HYBRID"),
    0x11ED: ("SecP384r1MLKEM1024", "PQ_HYBRID"),
    0x6399: ("X25519Kyber768Draft00", "PQ_OBSOLETE_DRAFT"),
    0x639A: ("SecP256r1Kyber768Draft00", "PQ_OBSOLETE_DRAFT"),
}
NAME = re.compile(r"TLS_(?:(?P<kx>ECDHE|DHE|RSA)(?:_(?P<sign>RSA|ECDSA))?_WITH_)?(?P<cipher>.+?)(?:_(?P<mode>CBC|GCM))?(?:_SHA(?:256|384)?)")


def signals_only(code: int) -> bool:
    """Whether a suite stands for a signal, not for any algorithm."""
    return SUITES[code].endswith("_SCSV")


def properties(code: int) -> dict[str, bool]:
    """What a suite's name says: static_kex (its key exchange has no forward secrecy), cbc, aead, tls13."""
    name = SUITES[code]
    if signals_only(code):
        return {"static_kex": False, "cbc": False, "aead": False, "tls13": False}
    return {"static_kex": name.startswith("TLS_RSA_"), "cbc": "_CBC_" in name, "aead": "_GCM_" in name or "_POLY1305_" in name, "tls13": "_WITH_" not in name}


def algorithms(code: int) -> list[tuple[str, str, str | None]]:
    """(name, primitive, mode) of what a suite is made of."""
    if signals_only(code):
        return []
    m = NAME.fullmatch(SUITES[code])
    kx, sign, mode = m["kx"], m["sign"], (m["mode"] or "").lower() or None
    cipher = m["cipher"].replace("CHACHA20_POLY1305", "ChaCha20-Poly1305").replace("_", "-")
    out = [] if kx is None else [(kx, "pke" if kx == "RSA" else "key-agree", None)]
    out += [] if sign is None else [(sign, "signature", None)]
    kind = "block-cipher" if mode == "cbc" else "stream-cipher" if cipher.startswith("RC4") else "ae"
    return [*out, (f"{cipher}-{mode.upper()}" if mode else cipher, kind, mode)]
