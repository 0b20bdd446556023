"""Costs of model calls from a price list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cost: Column) -> Column:
    """The sum of costs, an aggregate: exact, whatever the order of rows, where all have twelve decimals at most and fit; else a sum of doubles."""
    exact = cost.try_cast("decimal(38,12)")
    fits = F.bool_and(cost.isNull() | F.coalesce(exact.cast("double") == cost, F.lit(False)))
    return F.coalesce(F.when(fits, F.try_sum(exact)).cast("double"), F.sum(cost))


def _first(model: Column, prices: list[tuple], at: int) -> Column:
    """What the first price whose name the model contains has at a place; null without one."""
    return F.coalesce(*[F.when(F.contains(model, F.lit(p[1])), F.lit(float(p[at]))) for p in sorted(prices)], F.lit(None).cast("double"))


def priced(model: Column, tokens: Column, prices: list[tuple], fallback: float, inputs: Column | None = None, outputs: Column | None = None) -> Column:
    """Cost of a call in dollars; prices: (ordinal, name, input price, output price) per million tokens.

    Input and output tokens count where both are given, else 70 of 100 tokens
    are input; a model without a price costs the fallback per million. A price
    list is part of the expression, so nothing is joined.
    """
    guess = F.floor(tokens * 0.7)
    split = inputs.isNotNull() & outputs.isNotNull() if inputs is not None and outputs is not None else F.lit(False)
    ins = F.when(split, inputs).otherwise(guess) if inputs is not None and outputs is not None else guess
    outs = F.when(split, outputs).otherwise(tokens - guess) if inputs is not None and outputs is not None else tokens - guess
    cost = (ins * _first(model, prices, 2) + outs * _first(model, prices, 3)) / 1e6
    return F.round(F.coalesce(cost, tokens * fallback / 1e6), 9)
