"""Labels against findings, one to one within a message, as expressions on arrays: no Python, no join.

Each label in turn takes, of the findings that fit it and no label before took, the one of least penalty, then the first. Null arrays have no members; a message's arrays are as long as its labels and findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]


def one_to_one(takers: Column, offers: Column, fits: Pair, penalty: Pair | None = None) -> Column:
    """For each taker the index of its offer, or -1. takers and offers: arrays of structs."""
    some = F.coalesce(F.size(offers), F.lit(0)) > 0
    at = F.when(some, F.sequence(F.lit(0), F.size(offers) - 1)).otherwise(F.array().cast("array<int>"))
    cost = penalty or (lambda a, b: F.lit(0))

    def take(used: Column, one: Column) -> Column:
        free = F.filter(at, lambda i: ~F.array_contains(used, i) & F.coalesce(fits(one, F.get(offers, i)), F.lit(False)))
        best = F.array_min(F.transform(free, lambda i: F.struct(cost(one, F.get(offers, i)).cast("int").alias("p"), i.alias("i"))))
        return F.concat(used, F.array(F.coalesce(best["i"], F.lit(-1))))

    return F.coalesce(F.aggregate(takers, F.array().cast("array<int>"), take), F.array().cast("array<int>"))


def same_span(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def exact(a: Column, b: Column) -> Column:
    """Same value, place (where the label has one) and suggestion (where it wants one)."""
    return (a["value"] == b["value"]) & (b["start"].isNull() | b["end"].isNull() | same_span(a, b)) & (b["suggestion"].isNull() | a["suggestion"].isNull() | (a["suggestion"] == b["suggestion"]))


def touching(a: Column, b: Column) -> Column:
    """Overlapping, with the same value or the same place."""
    return overlap(a, b) & ((a["value"] == b["value"]) | same_span(a, b))


def same_value(a: Column, b: Column) -> Column:
    """The same value at the same or an overlapping place."""
    return (a["value"] == b["value"]) & (same_span(a, b) | overlap(a, b))


def inexact(a: Column, b: Column) -> Column:
    return (~same_span(a, b)).cast("int")


def inexact_or_wrong(a: Column, b: Column) -> Column:
    """The exact place counts before the right suggestion."""
    return 2 * (~same_span(a, b)).cast("int") + (~F.coalesce(a["suggestion"] == b["suggestion"], F.lit(False))).cast("int")


def hits(at: Column) -> Column:
    return F.size(F.filter(at, lambda i: i >= 0))


def corrected(takers: Column, offers: Column, at: Column) -> Column:
    """Matched takers whose offer has their suggestion."""
    return F.size(F.filter(F.arrays_zip(takers.alias("t"), at.alias("i")), lambda x: (x["i"] >= 0) & (x["t"]["suggestion"] == F.get(offers, x["i"])["suggestion"])))


def means_the_same(label: Column, finding: Column) -> Column:
    """Existence view: a finding within the label's place with its value and suggestion, whatever the rule of correction."""
    inside = label["start"].isNull() | label["end"].isNull() | ((finding["start"] >= label["start"]) & (finding["end"] <= label["end"]))
    return inside & (label["value"] == finding["value"]) & (label["suggestion"] == finding["suggestion"])
