"""Checksum validators as Column expressions: true, false, or null for no verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of Base58, the letters' numbers and the weights of places in vehicle numbers.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
VIN_FROM, VIN_TO = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Luhn over the digits, of which there are two at least."""
    d = digits(text)
    return (F.length(d) >= 2) & F.call_function("luhn_check", d)


def card(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(12, 19) & luhn(text)


def iban(text: Column) -> Column:
    """ISO 7064 mod 97 of the rotated number: letters count as 10 to 35."""
    s = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    turned = F.split(F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4))), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97))
    return F.length(s).between(15, 34) & (rest == 1)


def ssn(text: Column) -> Column:
    """False for numbers that cannot be issued, else no verdict."""
    d = digits(text)
    area = F.left(d, F.lit(3))
    bad = (F.length(d) != 9) | area.isin("000", "666") | area.startswith("9") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000")
    return F.when(bad, F.lit(False))


def vin(text: Column) -> Column:
    """ISO 3779 check digit; a bad one says nothing outside North America."""
    s = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    values = F.split(F.translate(s, VIN_FROM, VIN_TO), "")
    total = F.aggregate(F.zip_with(F.slice(values, 1, 17), F.array(*[F.lit(w) for w in VIN_WEIGHTS]), lambda v, w: v.try_cast("int") * w), F.lit(0), lambda a, v: a + v)
    check = F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))
    shaped = s.rlike("^[A-HJ-NPR-Z0-9]{17}$")
    return F.when(~shaped, F.lit(False)).when(F.substring(s, 9, 1) == check, F.lit(True)).when(s.rlike("^[1-5]"), F.lit(False))


LIMB, LIMBS = 24, 9


def wallet(text: Column) -> Column:
    """Base58Check: the last four bytes are the start of a double SHA-256 of those before.

    The number is kept as ``LIMBS`` limbs of ``LIMB`` bits, lowest first: a digit multiplies all by 58 and carries on.
    Texts of more than 36 digits exceed them and are no addresses.
    """
    limbs = F.array_repeat(F.lit(0).cast("long"), LIMBS)

    def push(number: Column, c: Column) -> Column:
        start = F.struct((F.instr(F.lit(BASE58), c) - 1).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        whole = lambda s, x: x * 58 + s["carry"]
        return F.aggregate(number, start, lambda s, x: F.struct(F.shiftright(whole(s, x), LIMB).alias("carry"), F.array_append(s["out"], whole(s, x).bitwiseAND(F.lit(2**LIMB - 1))).alias("out")))["out"]

    digits58 = F.regexp_extract_all(text, F.lit("(.)"), F.lit(1))
    number = F.aggregate(digits58, limbs, push)
    joined = F.array_join(F.transform(F.reverse(number), lambda x: F.lpad(F.hex(x), LIMB // 4, "0")), "")
    zeros = F.char_length(F.regexp_extract(text, "^(1*)", 1))
    raw = F.concat(F.repeat(F.lit("00"), zeros), F.regexp_replace(joined, "^(00)+", ""))
    body, check = F.left(raw, F.char_length(raw) - 8), F.right(raw, F.lit(8))
    sound = F.left(F.sha2(F.unhex(F.sha2(F.unhex(body), 256)), 256), F.lit(8)) == F.lower(check)
    return F.when(text.isNull(), None).when(text.rlike(f"^[{BASE58}]{{1,36}}$") & (F.char_length(raw) > 8), sound).otherwise(F.lit(False))


VERDICTS = {"iban": iban, "ssn": ssn, "card": card, "vin": vin, "wallet": wallet}
