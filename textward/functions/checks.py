"""Checks on candidate values: checksums, addresses, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(value: Column) -> Column:
    return F.translate(value, "- ", "")


def national_id_ok(digits: Column) -> Column:
    """13 digits whose last is (11 - sum(d[i] * (13 - i)) mod 11) mod 10."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(11)),
        F.lit(0),
        lambda acc, i: acc + F.substr(digits, i + 1, F.lit(1)).cast("int") * (F.lit(13) - i),
    )
    last = F.substring(digits, 13, 1).cast("int")
    return F.when(
        digits.rlike("^[0-9]{13}$"), last == (F.lit(11) - total % 11) % 10
    ).otherwise(False)


def card_ok(digits: Column) -> Column:
    """13 to 19 digits passing the Luhn check and not a valid national id."""
    return F.when(
        digits.rlike("^[0-9]{13,19}$"),
        F.call_function("luhn_check", digits) & ~((F.length(digits) == 13) & national_id_ok(digits)),
    ).otherwise(False)


def email_ok(m: Column) -> Column:
    """Rejects matches that touch address characters or hold doubled dots or several @."""
    edge = "^[._+A-Za-z0-9-]$"
    value = m["value"]
    return (
        ~m["before"].rlike(edge)
        & ~m["after"].rlike(edge)
        & ~F.contains(value, F.lit(".."))
        & (F.length(value) - F.length(F.replace(value, F.lit("@"), F.lit(""))) == 1)
    )


def ipv4_ok(value: Column) -> Column:
    """Four octets 0..255, none with a leading zero."""
    return F.forall(
        F.split(value, r"\."),
        lambda octet: octet.rlike("^(?:0|[1-9][0-9]{0,2})$") & (octet.cast("int") <= 255),
    )


def _v4_scope(first: Column, second: Column) -> Column:
    private = (
        (first == 10)
        | (first == 127)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | ((first == 169) & (second == 254))
    )
    return F.when(private, "private").otherwise("public")


def ipv4_scope(value: Column) -> Column:
    octets = F.split(value, r"\.")
    return _v4_scope(octets[0].cast("int"), octets[1].cast("int"))


def ipv6_ok(value: Column) -> Column:
    """Eight groups, or at most seven around a single '::'."""
    full = value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    side = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    short = value.rlike(f"^{side}::{side}$")
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    return full | (short & (groups <= 7))


def ipv6_scope(value: Column) -> Column:
    """Unique-local, link-local and loopback are private; mapped IPv4 uses its own scope."""
    head = F.conv(F.lpad(F.split(value, ":")[0], 4, "0"), 16, 10).cast("int")
    mapped = "^[0:]*:[fF]{4}:([0-9A-Fa-f]{1,4}):[0-9A-Fa-f]{1,4}$"
    high = F.conv(F.regexp_extract(value, mapped, 1), 16, 10).cast("int")
    return (
        F.when(value.rlike(mapped), _v4_scope(F.shiftright(high, 8), high.bitwiseAND(F.lit(255))))
        .when(value.rlike("^[0:]*:0{0,3}1$"), "private")
        .when(~F.startswith(value, F.lit(":")) & (head.bitwiseAND(F.lit(0xFE00)) == 0xFC00), "private")
        .when(~F.startswith(value, F.lit(":")) & (head.bitwiseAND(F.lit(0xFFC0)) == 0xFE80), "private")
        .otherwise("public")
    )


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    size = F.length(value)
    letters = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")

    def add(acc: Column, letter: Column) -> Column:
        share = (size - F.length(F.replace(value, letter, F.lit("")))) / size
        return acc - share * F.log2(share)

    return F.aggregate(letters, F.lit(0.0), add)
