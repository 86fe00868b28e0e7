"""Model calls under a cost limit: files are admitted in order, in waves, until the money spent has reached it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import usage
from .ranking import rank_in_group, running_sum

#: Places that one task ranks and sums: the rows carry prompts of whole texts.
CHUNK = 4096


class LimitReached(ValueError):
    """The limit was reached before the first call."""


@dataclass
class Budget:
    """A limit in dollars for the calls of a provider's model; ``spent_usd`` is what earlier runs have spent.

    A file is asked if less than the limit has been spent before it, the rule of calling one file after another. What a
    call costs is known afterwards only, so waves are sized by the dearest call so far. Answers beyond the limit in the last
    wave are not used, but were paid: ``paid_usd`` has all that was spent, ``calls`` the ledger rows of all calls.
    """

    limit_usd: float
    provider: str = "openai"
    model: str = "gpt-3.5-turbo"
    spent_usd: float = 0.0
    first_wave: int = 16
    prices: DataFrame | None = None
    paid_usd: float = 0.0
    waves: list[int] = field(default_factory=list)

    def start(self) -> None:
        if self.spent_usd >= self.limit_usd:
            raise LimitReached(f"the limit of ${self.limit_usd} was reached: ${self.spent_usd} are spent")


def _money(cost: Column) -> Column:
    """Costs as decimals, whose sums don't depend on the order."""
    return cost.cast("decimal(30,12)")


def answered_within(asked: DataFrame, budget: Budget, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(the answers of the admitted files, all answers that were paid), both written.

    ``asked`` has a unique integer ``seq``, in whose order files are admitted; ``answer`` adds ``prompt_tokens`` and
    ``completion_tokens`` to rows. A wave is one job; between waves the driver sees its number of rows and costs.
    """
    budget.start()
    ranked = rank_in_group(asked.withColumn("_all", F.lit(0)), ["_all"], "seq", "_place", CHUNK)
    ranked = materialize(ranked.drop("_all"), "asked")
    total, limit, spent = ranked.count(), Decimal(repr(float(budget.limit_usd))), Decimal(repr(float(budget.spent_usd)))
    at, wave, dearest, parts = 0, budget.first_wave, Decimal(0), []
    while at < total and spent < limit:
        rows = ranked.where((F.col("_place") > at) & (F.col("_place") <= at + wave))
        called = answer(rows).withColumns({"provider": F.lit(budget.provider), "model": F.lit(budget.model)})
        priced = materialize(usage.with_cost(called, budget.prices).drop("provider", "model"), "wave").withColumn("_cost", _money(F.coalesce("cost_usd", F.lit(0.0))))
        parts.append(running_sum(priced.withColumn("_all", F.lit(0)), ["_all"], "_place", F.col("_cost"), "_upto", CHUNK).withColumn(
            "_before", F.lit(spent).cast("decimal(30,12)") + F.col("_upto") - F.col("_cost")).drop("_all", "_upto"))
        seen = priced.agg(F.sum("_cost").alias("cost"), F.max("_cost").alias("dearest")).first()
        spent, dearest = spent + (seen["cost"] or 0), max(dearest, seen["dearest"] or Decimal(0))
        budget.waves.append(min(wave, total - at))
        at += wave
        fitting = int((limit - spent) / dearest) if dearest and spent < limit else wave * 4
        wave = max(1, min(wave * 4, fitting))
    budget.paid_usd = float(spent - Decimal(repr(float(budget.spent_usd))))
    if not parts:
        paid = answer(ranked.limit(0)).withColumns({"cost_usd": F.lit(0.0), "_before": F.lit(Decimal(0))})
        return paid.drop("_place", "_before", "cost_usd"), paid.drop("_place", "_before")
    paid = reduce(DataFrame.unionByName, parts).drop("_cost")
    admitted = paid.where(F.col("_before") < F.lit(limit).cast("decimal(30,12)"))
    return admitted.drop("_place", "_before", "cost_usd"), paid.drop("_place", "_before")
