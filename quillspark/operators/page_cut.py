"""Parts of a page's text, as expressions over the array of its atoms: rows, gaps, spaces, drop caps. ``page_arrays`` has the whole cut of
pages to regions and lines; both share the values here.

Atoms are in the order of their baselines. All groupings are ordered folds that keep starts or gaps only. An atom is a struct of base,
x0, k (its place in the page), x1, top, bot, size, text, bold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import bind
from ..functions.text import trimmed

#: The tuning of the cut. Gaps are in ems, shares of the page's width, or of the distance of lines.
MAX_DEPTH, LEAST_ATOMS = 14, 3
GUTTER, GUTTER_PAGE, NARROW, NARROW_PAGE = 1.15, 0.018, 0.5, 0.008
WORD_SPACES, STRAIGHT, BESIDE, SHARED_ROWS = 1.8, 0.55, 3, 0.75
REGION_WIDTH, SIDE_WIDTH, BAND_PITCH, BAND_EMS = 0.34, 0.10, 0.7, 0.95
ROW, LINE, CAP, CAP_TEXT = 0.4, 0.62, 1.7, 0.7
LEAST_SPACE, LEAST_SPACES, MOST_SPACES = 0.05, 8, 0.9

ATOM = "struct<base double, x0 double, k int, x1 double, top double, bot double, size double, text string, bold boolean>"


def _each(xs: Column, field: str) -> Column:
    return F.transform(xs, lambda x: x[field])


def _up_to(n: Column, first: int = 0) -> Column:
    """first .. n - 1; empty if there is none."""
    return F.when(n > first, F.sequence(F.lit(first), F.greatest(n - 1, F.lit(first)))).otherwise(F.array().cast("array<int>"))


def median(xs: Column) -> Column:
    """Of an array, the mean of the middle pair; null if it is empty."""
    return bind(F.sort_array(xs), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def _or_ten(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(10.0))


def anchored(atoms: Column, near: Callable[[Column, Column], Column]) -> Column:
    """Atoms in the order of their baselines as groups: each within ``near`` (first of the group, own place) of the first."""

    def step(s: Column, i: Column) -> Column:
        apart = F.get(atoms, i)["base"] - F.get(atoms, s["first"])["base"]
        new = (apart > 0) & (apart > near(s["first"], i))
        return F.when(new, F.struct(i.alias("first"), F.concat(s["starts"], F.array(i)).alias("starts"))).otherwise(s)

    start = F.struct(F.lit(0).alias("first"), F.array(F.lit(0)).alias("starts"))
    starts = F.aggregate(_up_to(F.size(atoms), 1), start, step, lambda s: s["starts"])
    groups = lambda at: F.transform(at, lambda a, j: F.slice(atoms, a + 1, F.coalesce(F.get(at, j + 1), F.size(atoms)) - a))
    return F.when(F.size(atoms) > 0, bind(starts, groups)).otherwise(F.array().cast(f"array<array<{ATOM}>>"))


def baseline_rows(atoms: Column) -> Column:
    """The rows of atoms that share a baseline, as arrays."""
    return bind(atoms, lambda xs: anchored(xs, lambda _, i: ROW * _or_ten(F.get(xs, i)["size"])))


def _edges(rows: Column) -> Column:
    """Of each row its baseline, both edges, and how near another baseline is the same."""
    return F.transform(
        rows, lambda r: F.struct(
            F.get(r, F.lit(0))["base"].alias("base"), F.array_min(_each(r, "x0")).alias("begin"), F.array_max(_each(r, "x1")).alias("end"),
            (ROW * _or_ten(median(_each(r, "size")))).alias("near"),
        )
    )


def channels(spans: Column, least: Column) -> Column:
    """Uncovered stretches (before, after) of at least this width between spans (low, high), by a running maximum."""

    def step(s: Column, x: Column) -> Column:
        gap = (x["low"] > s["reach"]) & (x["low"] - s["reach"] >= least)
        found = F.when(gap, F.concat(s["out"], F.array(F.struct(s["reach"].alias("before"), x["low"].alias("after"))))).otherwise(s["out"])
        return F.struct(F.greatest(s["reach"], x["high"]).alias("reach"), found.alias("out"))

    def swept(xs: Column) -> Column:
        start = F.struct(F.get(xs, F.lit(0))["high"].alias("reach"), F.array().cast("array<struct<before double, after double>>").alias("out"))
        return F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), start, step, lambda s: s["out"])

    return bind(F.sort_array(spans), swept)


def word_spaces(rows: Column, gaps: Column) -> Column:
    """The spaces between neighbours of a row, but for those that meet one of the gaps."""

    def of_row(r: Column) -> Column:
        spaces = F.transform(_up_to(F.size(r), 1), lambda i: F.struct(F.get(r, i - 1)["x1"].alias("a"), F.get(r, i)["x0"].alias("b")))
        return F.filter(spaces, lambda s: (s["b"] - s["a"] > LEAST_SPACE) & ~F.exists(gaps, lambda g: (s["a"] < g["after"]) & (s["b"] > g["before"])))

    in_order = lambda r: F.sort_array(F.transform(r, lambda a: F.struct(a["x0"].alias("x0"), a["base"].alias("base"), a["k"].alias("k"), a["x1"].alias("x1"))))
    return F.transform(F.flatten(F.transform(rows, lambda r: bind(in_order(r), of_row))), lambda s: s["b"] - s["a"])


def typical_space(rows: Column, gaps: Column) -> Column:
    """The element at nine tenths of the sorted spaces; 0 where these are too few to be those of words."""
    at = lambda s: F.get(s, F.floor(F.size(s) * MOST_SPACES).cast("int"))
    return bind(F.sort_array(word_spaces(rows, gaps)), lambda s: F.when(F.size(s) >= F.greatest(F.lit(LEAST_SPACES), 2 * F.size(rows)), at(s)).otherwise(0.0))


def shared_rows(mine: Column, theirs: Column) -> Column:
    """How many of these rows share their baseline with one of the others."""
    return F.size(F.filter(mine, lambda r: F.exists(theirs, lambda t: F.abs(t["base"] - r["base"]) <= r["near"])))


def drop_caps(atoms: Column) -> Column:
    """Large initials of a region: place of the initial, its text, and the place of the atom that it begins: the highest of
    those that wrap around it."""

    def judged(large: Column) -> Column:
        wraps = lambda c: lambda a: (
            (a["size"] < CAP_TEXT * c["size"]) & (a["base"] > c["top"]) & (a["base"] < c["base"] - 0.5 * a["size"]) & a["x0"].between(c["x1"] - 1, c["x1"] + c["size"])
        )
        caps = F.filter(atoms, lambda c: (c["size"] >= CAP * large) & (F.length(trimmed(c["text"])) <= 2))
        # Of atoms on one baseline the first of the page.
        highest = lambda c: F.array_min(F.transform(F.filter(atoms, wraps(c)), lambda a: F.struct(a["base"].alias("base"), a["x0"].alias("x0"), a["k"].alias("k"))))["k"]
        found = F.transform(caps, lambda c: F.struct(c["k"].alias("k"), trimmed(c["text"]).alias("text"), highest(c).alias("target")))
        return F.filter(found, lambda c: c["target"].isNotNull())

    return bind(_or_ten(median(_each(atoms, "size"))), judged)
