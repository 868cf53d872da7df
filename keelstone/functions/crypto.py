"""Decoding of encrypted texts: keys on the driver, the cipher inside the JVM."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bind

# Fixed value: fewer rounds are refused.
LEAST_ROUNDS = 600_000


def master_key(password: str, email: str, rounds: int) -> bytes:
    """PBKDF2-SHA256 with the trimmed lower-case address as salt. (A memory-hard derivation needs a
    library that is not there; its key can be passed to stretch() directly.)"""
    if rounds < LEAST_ROUNDS:
        raise ValueError("too few rounds of key derivation")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), email.strip().lower().encode(), rounds, 32)


def stretch(master: bytes) -> tuple[bytes, bytes]:
    """(encryption key, MAC key) by two HKDF expansions of the master key."""
    one = lambda info: hmac.new(master, info + b"\x01", hashlib.sha256).digest()
    return one(b"enc"), one(b"mac")


def split_key(key: bytes) -> tuple[bytes, bytes]:
    if len(key) != 64:
        raise ValueError("a key has 64 bytes")
    return key[:32], key[32:]


_PARTS = r"\A2\.([A-Za-z0-9+/=]+)\|([A-Za-z0-9+/=]+)\|([A-Za-z0-9+/=]+)\z"


def _xor(key: Column, with_byte: int) -> Column:
    """64 bytes: the 32 of key and 32 zeros, each combined with one byte."""
    one = lambda i: F.lpad(F.hex(F.conv(F.hex(F.substring(key, i, 1)), 16, 10).cast("bigint").bitwiseXOR(F.lit(with_byte))), 2, "0")
    return F.concat(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), one), "")), F.lit(bytes([with_byte] * 32)))


def keys(enc: Column, mac: Column) -> Column:
    """struct(enc, inner, outer): a key made ready for decrypted(); null if a part has not 32 bytes."""
    whole = (F.octet_length(enc) == 32) & (F.octet_length(mac) == 32)
    return F.when(whole, F.struct(enc.alias("enc"), _xor(mac, 0x36).alias("inner"), _xor(mac, 0x5C).alias("outer")))


def constant_key(key: tuple[bytes, bytes]) -> Column:
    """keys() of a key that is known on the driver."""
    enc, mac = key
    return F.struct(F.lit(enc).alias("enc"), F.lit(bytes(b ^ 0x36 for b in mac.ljust(64, b"\0"))).alias("inner"), F.lit(bytes(b ^ 0x5C for b in mac.ljust(64, b"\0"))).alias("outer"))


def _hash(message: Column) -> Column:
    return F.unhex(F.sha2(message, 256))


def decrypted_bytes(text: Column, key: Column) -> Column:
    """Clear bytes of "2.iv|data|mac" (AES-256-CBC, HMAC-SHA256) with a struct of keys(). Only this type
    is read, and only if the MAC holds; else null. All of it are built-in functions, so it also works
    on array elements and with a key of its own for each row."""
    part = lambda n: F.try_to_binary(F.when(text.rlike(_PARTS), F.regexp_extract(text, _PARTS, n)), F.lit("base64"))
    cut = F.struct(part(1).alias("iv"), part(2).alias("data"), part(3).alias("mac"))

    def clear(p: Column) -> Column:
        shaped = (F.octet_length(p.iv) == 16) & (F.octet_length(p.mac) == 32) & (F.octet_length(p.data) > 0) & (F.octet_length(p.data) % 16 == 0)
        body = F.concat(p.iv, p.data)
        holds = _hash(F.concat(key["outer"], _hash(F.concat(key["inner"], body)))) == p.mac
        return F.when(shaped & holds, F.try_aes_decrypt(body, key["enc"], F.lit("CBC"), F.lit("PKCS")))

    return bind(cut, clear)


def decrypted(text: Column, key: Column) -> Column:
    """Clear text, null if it is no UTF-8."""
    return F.try_validate_utf8(decrypted_bytes(text, key).cast("string"))
