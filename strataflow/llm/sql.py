"""Small helpers for native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a regex class: space and the ASCII controls 9 to 13.
BLANK = r"[\x20\x09-\x0D]"
INK = r"[^\x20\x09-\x0D]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unused(frame: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``frame`` has it, in either case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of ``text`` (runs between ASCII white space); none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def windows(n: Column, width: int) -> Column:
    """0-based starts of all windows of ``width`` among ``n`` items."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


#: Items that a running total takes at once.
RUN = 512


def running(values: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each item of ``values`` what ``join`` makes of ``start`` and all items before it.

    Runs of RUN items are totalled first, so that building the result copies no long array
    again and again.
    """

    def scan(xs: Column, first: Column) -> Column:
        none = F.struct(first.alias("at"), F.slice(F.array(first), 1, 0).alias("out"))
        return F.aggregate(xs, none, lambda acc, x: F.struct(join(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    def of(xs: Column) -> Column:
        runs = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(runs, lambda k: F.slice(xs, k * RUN + 1, RUN)), spread)

    def spread(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, start, join))
        return let(scan(totals, start), lambda starts: F.flatten(F.transform(parts, lambda p, k: scan(p, F.get(starts, k)))))

    return F.when(F.size(values) > RUN, let(values, of)).otherwise(scan(values, start))
