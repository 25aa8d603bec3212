"""Rounding and arithmetic that give the values of Python's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 62


def exact_round(x: Column, places: int) -> Column:
    """round(x, places) as Python does it: half to even on the exact binary value.

    Spark's round and bround work on the shortest decimal form instead, so 12.35 (whose
    exact value lies below) would become 12.4. Here the fraction is scaled to an integer
    by a power of two, which is exact, and compared as one. For |x| below 10^12.
    """
    size = F.abs(x)
    whole = F.floor(size)
    fraction = ((size - whole) * F.lit(float(1 << _BITS))).cast("long").cast("decimal(38,0)")
    scaled = fraction * F.lit(10**places).cast("decimal(7,0)")
    unit = F.lit(1 << _BITS).cast("decimal(38,0)")
    low = F.floor(scaled / unit).cast("decimal(38,0)")
    # decimal division may round up at the edge of its scale
    low = F.when(low * unit > scaled, low - 1).otherwise(low).cast("decimal(38,0)")
    rest = ((scaled - low * unit) * 2).cast("decimal(38,0)")
    up = (rest > unit) | ((rest == unit) & ((low % 2 == 1) if places else ((low + whole) % 2 == 1)))
    cents = whole.cast("decimal(20,0)") * F.lit(10**places).cast("decimal(7,0)") + low + F.when(up, 1).otherwise(0)
    value = cents.cast("double") / float(10**places)
    return F.when(x < 0, -value).otherwise(value)


def exact_round_sql(x: str, places: int) -> str:
    """The same in DuckDB's SQL, over its 128-bit integers."""
    unit = f"{1 << _BITS}::HUGEINT"
    fraction = f"(CAST(trunc((abs({x}) - floor(abs({x}))) * {float(1 << _BITS)!r}) AS HUGEINT) * {10**places})"
    low, rest = f"({fraction} // {unit})", f"(({fraction} % {unit}) * 2)"
    parity = f"({low} % 2 = 1)" if places else f"(({low} + CAST(floor(abs({x})) AS HUGEINT)) % 2 = 1)"
    cents = f"(CAST(floor(abs({x})) AS HUGEINT) * {10**places} + {low} + CASE WHEN {rest} > {unit} OR ({rest} = {unit} AND {parity}) THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * CAST({cents} AS DOUBLE) / {float(10**places)!r})"


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of a call at prices per million tokens, to six places."""
    return exact_round(tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out, 6)


def stt_credits(minutes: Column, per_minute: int = 280) -> Column:
    return F.floor(minutes * per_minute).cast("int")


def stt_cost(minutes: Column, per_minute: float = 0.005) -> Column:
    return exact_round(minutes * per_minute, 4)


def minutes_of(milliseconds: Column) -> Column:
    return exact_round(milliseconds / 60000, 2)


def megabytes(size: Column) -> Column:
    return exact_round(size / 1048576, 2)
