"""Keys of people, identifiers and content, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.dates import dob_key, let

#: Country codes that may stand before an identifier.
COUNTRIES = ["AUS", "CHN", "NZL", "GBR", "CAN", "USA", "HKG", "SGP", "IND", "PHL", "VNM"]


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def identity_id(family: Column, given: Column, dob: Column) -> Column:
    """First 16 hex digits of the hash of family name, given names and date of birth; null if any is blank."""
    parts = F.array(name_key(family), name_key(given), dob_key(dob))
    return let(parts, lambda p: F.when(~F.array_contains(p, ""), F.substring(F.sha2(F.array_join(p, "|"), 256), 1, 16)))


def identifier(c: Column) -> Column:
    """Canonical form: upper case, the first of several, without country code, spaces, dots and hyphens."""
    first = F.trim(F.element_at(F.split(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[;/]"), 1))
    bare = F.regexp_replace(first, f"^({'|'.join(COUNTRIES)}) ", "")
    return F.regexp_replace(F.trim(bare), r"[\s.\-]+", "")


def identifier_valid(kind: Column, canonical: Column) -> Column:
    """Passports: one or two letters, then six to eight digits. Licences: seven to ten letters and digits, at most two of them letters."""
    head = F.regexp_replace(canonical, "[0-9]+$", "")
    numbers = F.length(canonical) - F.length(head)
    letters = F.length(F.regexp_replace(canonical, "[^A-Z]", ""))
    every = F.regexp_replace(canonical, "[A-Z0-9]", "") == ""
    passport = every & (letters == F.length(head)) & letters.between(1, 2) & numbers.between(6, 8)
    licence = every & F.length(canonical).between(7, 10) & (letters <= 2)
    return F.when(kind == "passport", passport).when(kind == "licence", licence).otherwise(F.lit(False))


def explanation(kind: Column, canonical: Column, sources: Column) -> Column:
    """Why an identifier has its tier, in words."""
    return (
        F.when(~identifier_valid(kind, canonical), F.concat(F.lit("not the form of a "), kind))
        .when(sources >= 2, F.concat(F.lit("the same in "), sources.cast("string"), F.lit(" documents")))
        .otherwise(F.lit("in one document only"))
    )


def tier(kind: Column, canonical: Column, sources: Column) -> Column:
    return F.when(~identifier_valid(kind, canonical), "format_fail").when(sources >= 2, "triple_checked").otherwise("single_source")


def sample_bucket(key: Column, buckets: int) -> Column:
    """SHA-256 of the key as one large integer, modulo buckets."""
    steps = F.split(F.regexp_replace(F.sha2(key, 256), "(.)", "$1 "), " ")
    return F.aggregate(F.filter(steps, lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: (a * 16 + F.conv(x, 16, 10).cast("long")) % buckets)
