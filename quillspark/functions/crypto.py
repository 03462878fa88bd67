"""Keyed hashes, sealing and proofs of work as Column expressions; F21 to F25 and F27."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEALED = r"^v1\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"


def sha256_hex(c: Column) -> Column:
    """F21."""
    return F.sha2(c, 256)


def hmac_sha256(key: str, c: Column) -> Column:
    """HMAC-SHA256 in hex, from two nested SHA-256 over the padded key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    message = F.encode(c, "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def code_hmac(secret: str, code: Column) -> Column:
    return hmac_sha256(f"code:{secret}", code)


def name_hmac(secret: str, name: Column) -> Column:
    return hmac_sha256(f"name:{secret}", F.lower(name))


def category_hmac(secret: str, category: Column) -> Column:
    """Categories share the key of names, behind a prefix that no name has."""
    return hmac_sha256(f"name:{secret}", F.concat(F.lit("sensitive:"), category))


def is_hmac(c: Column) -> Column:
    """P25."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def base64url(c: Column) -> Column:
    """bytes to base64url without padding or line ends."""
    return F.regexp_replace(F.translate(F.base64(c), "+/", "-_"), "[=\r\n]", "")


def from_base64url(c: Column) -> Column:
    """F24."""
    return F.unbase64(F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("=")))


def seal(c: Column, key: Column) -> Column:
    """AES-256-GCM as v1.iv.ciphertext; each call draws a new iv."""
    # Twelve bytes of iv are sixteen characters, so the parts split without a second encryption.
    return F.regexp_replace(base64url(F.aes_encrypt(F.encode(c, "UTF-8"), key, F.lit("GCM"))), "^(.{16})", r"v1.$1.")


def unseal(c: Column, key: Column) -> Column:
    """the text of an envelope, or null where key or envelope is wrong."""
    # One look at the envelope: Spark may evaluate a sealing expression anew for each reference.
    whole = from_base64url(F.regexp_replace(c, r"^v1\.([^.]*)\.(.*)$", "$1$2"))
    return F.when(is_sealed(c), F.decode(F.try_aes_decrypt(whole, key, F.lit("GCM")), "UTF-8"))


def is_sealed(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(SEALED)


def leading_zero_bits(hexed: Column) -> Column:
    """zero bits before the first one bit of a hex string."""
    zeros = F.length(hexed) - F.length(F.ltrim(hexed, F.lit("0")))
    digit = F.conv(F.substr(hexed, zeros + 1, F.lit(1)), 16, 10).cast("int")
    more = F.when(digit.isNull(), 0).when(digit >= 8, 0).when(digit >= 4, 1).when(digit >= 2, 2).otherwise(3)
    return (zeros * 4 + more).cast("int")


def work_verdict(secret: str, challenge: Column, issued_ms: Column, mac: Column, nonce: Column, difficulty: int, now_ms: int, window_ms: int = 600_000, skew_ms: int = 60_000) -> Column:
    """Why a proof of work is refused, or null; in the order malformed, expired, forged, weak."""
    bound = F.concat_ws(":", challenge, issued_ms.cast("string"))
    return (
        F.when(challenge.isNull() | nonce.isNull() | issued_ms.isNull() | ~is_hmac(mac), "malformed")
        .when((F.lit(now_ms) - issued_ms > window_ms) | (issued_ms - F.lit(now_ms) > skew_ms), "expired")
        .when(hmac_sha256(f"pow:{secret}", bound) != mac, "forged")
        .when(leading_zero_bits(F.sha2(F.concat_ws(":", challenge, nonce), 256)) < difficulty, "weak")
    )


def consent_wording_digest(copy: Column) -> Column:
    """F27."""
    return F.sha2(F.concat(F.lit("sensitive-consent-v1\n"), copy), 256)
