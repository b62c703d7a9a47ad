"""Pseudonym tokens: ``[LABEL:keyid:BODY]``, made and opened by expressions alone.

A value is normalised, sealed under its label and written in Base32. The seal is
deterministic and authenticated: the initial vector of the cipher is a keyed hash of label and
value and stands before the ciphertext, so equal values give equal tokens and opening checks that
the vector is that of what comes out. (AES in CBC mode with a SHA-256 vector stands for AES-SIV.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
TOKEN = r"\[[A-Z_]+:[A-Za-z0-9-]+:[A-Z2-7]+\]"


def normalised(label: Column, value: Column) -> Column:
    """Phone numbers as plus sign and digits, all else in lower case with white space collapsed."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.when(F.lower(label).startswith("phone"), F.regexp_replace(value, "[^+0-9]", "")).otherwise(plain)


def base32(data: Column) -> Column:
    """Binary in Base32 without padding."""
    bits = F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit("(.)"), F.lit(1)), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    whole = F.rpad(bits, F.ceil(F.char_length(bits) / 5).cast("int") * 5, F.lit("0"))
    return F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("(.{5})"), F.lit(1)), lambda b: F.substring(F.lit(BASE32), F.conv(b, 2, 10).cast("int") + 1, F.lit(1))), "")


def unbase32(text: Column) -> Column:
    """Binary from Base32 without padding."""
    bits = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(.)"), F.lit(1)), lambda c: F.lpad(F.conv((F.instr(F.lit(BASE32), c) - 1).cast("string"), 10, 2), 5, "0")), "")
    whole = F.left(bits, F.floor(F.char_length(bits) / 8).cast("int") * 8)
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("(.{8})"), F.lit(1)), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))


def vector(key: str, label: Column, value: Column) -> Column:
    """The sixteen bytes that stand for label and value under a key."""
    inner = F.sha2(F.concat(F.lit(f"{key}|in|"), label, F.lit("\0"), value).cast("binary"), 256)
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(f"{key}|out|"), inner).cast("binary"), 256)), 1, 16)


def cipher_key(key: str) -> Column:
    return F.unhex(F.sha2(F.lit(f"{key}|cipher").cast("binary"), 256))


def token(label: Column, value: Column, key_id: str, key: str) -> Column:
    """The token of a value; null for null."""
    plain, name = normalised(label, value), F.upper(label)
    sealed = F.aes_encrypt(plain.cast("binary"), cipher_key(key), F.lit("CBC"), F.lit("PKCS"), vector(key, name, plain))
    return F.concat(F.lit("["), name, F.lit(f":{key_id}:"), base32(sealed), F.lit("]"))


def reveal(text: Column, keys: dict[str, str]) -> Column:
    """The normalised value of a token under its key, active or retired; null if the token is malformed, altered, or of an unknown key."""
    part = lambda n: F.regexp_extract(text, r"^\[([A-Z_]+):([A-Za-z0-9-]+):([A-Z2-7]+)\]$", n)
    out = F.lit(None).cast("string")
    for key_id, key in keys.items():
        plain = F.try_aes_decrypt(unbase32(part(3)), cipher_key(key), F.lit("CBC"), F.lit("PKCS")).cast("string")
        sound = vector(key, part(1), plain) == F.substring(unbase32(part(3)), 1, 16)
        out = F.when(part(2) == key_id, F.when(sound, plain)).otherwise(out)
    return out
