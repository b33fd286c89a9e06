"""Similarity scores of names and addresses, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def grams(c: Column, n: Column | int) -> Column:
    """The distinct n-grams of a string; one no longer than n is its own."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(c) <= n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient over distinct grams: pairs of characters where both have four or more, single ones else."""
    n = F.when(F.least(F.length(a), F.length(b)) >= 4, 2).otherwise(1)
    ga, gb = grams(a, n), grams(b, n)
    return 2.0 * F.size(F.array_intersect(ga, gb)) / F.greatest(F.size(ga) + F.size(gb), F.lit(1))


def edit(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def fuzzy(a: Column, b: Column) -> Column:
    """0 where either is blank, 1 where equal, else the larger of dice and edit similarity."""
    return F.when((F.trim(a) == "") | (F.trim(b) == ""), 0.0).when(a == b, 1.0).otherwise(clamp(F.greatest(dice(a, b), edit(a, b))))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def address_score(a: Column, b: Column) -> Column:
    return F.when((F.trim(a) == "") | (F.trim(b) == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.92).otherwise(F.least(F.lit(0.9), fuzzy(a, b)))


def entity_score(name: Column, address: Column) -> Column:
    return F.when((name < 0.25) | (address < 0.25), F.least(name, address)).otherwise(0.55 * name + 0.45 * address)


def stem_score(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((F.least(F.length(a), F.length(b)) >= 2) & (a.contains(b) | b.contains(a)), 0.95).otherwise(fuzzy(a, b))


def identity_confidence(*, same_site: Column, postal_a: Column, postal_b: Column, same_name: Column, blank_address: Column, name: Column, stem: Column, address: Column) -> Column:
    """Ladder of evidence that two records are one; null where none holds."""
    same_postal = F.coalesce(postal_a == postal_b, F.lit(False))
    return (
        F.when(same_site, 1.0)
        .when(F.coalesce(postal_a != postal_b, F.lit(False)), F.lit(None).cast("double"))
        .when(same_name & blank_address, 0.90)
        .when(same_name & same_postal, 0.99)
        .when(same_name & (address >= 0.70), 0.72 + 0.28 * address)
        .when(same_postal & (stem >= 0.70) & (address >= 0.70), 0.58 + 0.20 * stem + 0.20 * address)
        .when((name >= 0.82) & (address >= 0.82), 0.55 * name + 0.45 * address)
        .when((address >= 0.96) & (name >= 0.65), 0.45 * name + 0.55 * address)
    )


def romanised_address_score(native: Column, latin: Column, prefectures: dict[str, str]) -> Column:
    """0.60 for equal postal codes (0 where they differ), 0.32 for equal numbers, 0.08 for a pair of prefectures."""
    postal = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, r"(\d{3}-?\d{4})", 1), "-", ""), F.lit(""))
    numbers = lambda c: F.transform(F.regexp_extract_all(F.regexp_replace(c, r"\d{3}-?\d{4}", " "), F.lit(r"(\d+)")), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    a, b = postal(native), postal(latin)
    same_numbers = (F.size(numbers(native)) > 0) & (F.array_sort(numbers(native)) == F.array_sort(numbers(latin)))
    named = F.lit(False)
    for native_name, latin_name in prefectures.items():
        named = named | (native.contains(native_name) & F.lower(latin).contains(latin_name.lower()))
    score = F.when(F.coalesce(a == b, F.lit(False)), 0.60).otherwise(0.0) + F.when(same_numbers, 0.32).otherwise(0.0) + F.when(named, 0.08).otherwise(0.0)
    return F.when(F.coalesce(a != b, F.lit(False)), 0.0).otherwise(score)
