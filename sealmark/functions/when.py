"""Times and gates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealmark.schema import EXITS


def parsed(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(text)


def gap_seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b, with sign; null if either is null."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def due(prev: Column, now: Column, weekday: int | None, hour: int, every_days: int) -> Column:
    """Whether a cadence has come round: on its weekday (Monday is 0), from its hour on, so many days after the last time."""
    day = F.lit(True) if weekday is None else F.weekday(now) == weekday
    return day & (F.hour(now) >= hour) & (prev.isNull() | (F.datediff(now, prev) >= every_days))


def exit_name(code: Column) -> Column:
    """Code and name of an exit; unknown codes say so."""
    names = F.create_map(*(F.lit(x) for kv in EXITS.items() for x in kv))
    return F.concat(code.cast("string"), F.lit(" "), F.coalesce(F.try_element_at(names, code), F.lit("UNKNOWN_EXIT")))


def gate(value: Column) -> Column:
    """``report`` only if the registry says so; anything else gates the ship."""
    return F.when(value == "report", "report").otherwise("ship")
