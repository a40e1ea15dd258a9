"""Well-test and intake expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reconcile(first: Column, second: Column) -> Column:
    """The first source's value, else the second's."""
    return F.coalesce(first, second)


def diverges(first: Column, second: Column, most: float = 1.0) -> Column:
    """Whether both sources are there and differ by more than ``most``."""
    return F.coalesce(F.abs(first - second) > most, F.lit(False))


def test_flags(static: Column, dynamic: Column, flow: Column, hours: Column, least_hours: float = 4.0) -> Column:
    """Names of the reasons that make a pumping test doubtful."""
    return F.array_compact(
        F.array(
            F.when(dynamic <= static, F.lit("level_order")),
            F.when(flow <= 0, F.lit("no_flow")),
            F.when(hours < least_hours, F.lit("short_test")),
        )
    )


def specific_capacity(flow: Column, static: Column, dynamic: Column, sheet: Column, cadastre: Column) -> Column:
    """(qs, source): computed from the test where it is sound, else from the sheet, else from the cadastre."""
    computed = F.when((flow > 0) & (dynamic > static), flow / (dynamic - static))
    sheet, cadastre = F.when(sheet > 0, sheet), F.when(cadastre > 0, cadastre)
    source = F.when(computed.isNotNull(), "computed").when(sheet.isNotNull(), "sheet").when(cadastre.isNotNull(), "cadastre")
    return F.struct(F.coalesce(computed, sheet, cadastre).alias("qs"), source.alias("source"), F.coalesce(F.abs(computed - sheet) / sheet > 0.2, F.lit(False)).alias("inconsistent"))


def saturated_thickness(static: Column, top: Column, base: Column) -> Column:
    """Length of the intake below the water level, at least 0."""
    return F.greatest(F.lit(0.0), base - F.greatest(static, top))


def transmissivity(qs: Column, a: Column, b: Column) -> Column:
    """Power law a * (24 qs)^b."""
    return a * F.pow(24.0 * qs, b)


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` held within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
