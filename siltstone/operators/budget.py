"""Costs, budgets and retries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rate, in dollars a million tokens, of models that the price table does not list.
DEFAULT_RATE = 0.02
# fixed values: exceptions that are worth another try
TRANSIENT_NAMES = ("APIConnectionError", "APITimeoutError", "RateLimitError")


class BudgetExceeded(RuntimeError):
    """A reservation found too little left, or a settled cost went over the cap."""


@dataclass
class Budget:
    """Dollars: spent, and reserved under a number until the cost is known."""

    cap: float
    spent: float = 0.0
    reserved: dict[int, float] = field(default_factory=dict)
    last: int = 0

    @property
    def remaining(self) -> float:
        return self.cap - self.spent - sum(self.reserved.values())

    def reserve(self, amount: float) -> int:
        if amount > self.remaining:
            raise BudgetExceeded(f"{amount:.6f} asked, {self.remaining:.6f} left")
        self.last += 1
        self.reserved[self.last] = amount
        return self.last

    def settle(self, number: int, cost: float) -> None:
        """The cost is recorded even where it goes over the cap, which is an error then."""
        self.reserved.pop(number)
        self.spent += cost
        if self.spent > self.cap:
            raise BudgetExceeded(f"{self.spent:.6f} spent of {self.cap:.6f}")


def ledger(events: DataFrame, key: str, seq: str, cap: float) -> DataFrame:
    """The same over a table of events (kind reserve or settle, number, amount): spent, reserved, remaining after each, and ``ok``."""
    reserve, settle = F.col("kind") == "reserve", F.col("kind") == "settle"
    opened = events.where(reserve).select(key, "number", F.col("amount").alias("_opened"))
    rows = events.join(opened, [key, "number"], "left")
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.when(settle, F.col("amount")).otherwise(0.0)).over(w)
    held = F.sum(F.when(reserve, F.col("amount")).when(settle, -F.coalesce("_opened", F.lit(0.0))).otherwise(0.0)).over(w)
    rows = rows.withColumn("spent", F.round(spent, 6)).withColumn("reserved", F.round(held, 6)).withColumn("remaining", F.round(cap - F.col("spent") - F.col("reserved"), 6))
    return rows.withColumn("ok", F.when(reserve, F.col("remaining") >= 0).otherwise(F.col("spent") <= cap)).drop("_opened")


def costs(calls: DataFrame, prices: DataFrame, model: str, tokens: str) -> DataFrame:
    """(model, cost, calls): sums of tokens at the model's rate for a million (prices: model, rate), DEFAULT_RATE if it has none."""
    sums = calls.groupBy(model).agg(F.sum(tokens).alias("_t"), F.count("*").alias("calls"))
    return sums.join(F.broadcast(prices.select(model, "rate")), model, "left").select(model, F.round(F.col("_t") / 1e6 * F.coalesce("rate", F.lit(DEFAULT_RATE)), 9).alias("cost"), "calls")


def reserve_ceiling(n: Column, rate: Column) -> Column:
    """What a batch of ``n`` calls may cost at most: a thousand tokens each, one call at least."""
    return F.greatest(n, F.lit(1)) * 1000 / 1e6 * rate


def cache_ratio(calls: DataFrame, key: str, seq: str, read: str, created: str, first: int, least: float | None = None) -> DataFrame:
    """(key, ratio): cache reads among reads and creations of the first calls; null where there are neither.  With ``least`` also ``low``."""
    w = Window.partitionBy(key).orderBy(seq)
    rows = calls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    ratio = F.round(F.sum(read) / F.nullif(F.sum(read) + F.sum(created), F.lit(0.0)), 9)
    out = rows.groupBy(key).agg(ratio.alias("ratio"))
    return out if least is None else out.withColumn("low", F.coalesce(F.col("ratio") < least, F.lit(False)))


def retry_class(status: Column, error: Column | None = None) -> Column:
    """transient, budget, fatal or ok: by the exception's name where that is known to pass, else by HTTP status; an error without either is fatal."""
    by_status = F.when((status == 429) | (status.between(500, 599) & (status != 503)), "transient").when(status == 402, "budget").when(status >= 400, "fatal")
    if error is None:
        return F.coalesce(by_status, F.lit("ok"))
    return F.when(error.isin(*TRANSIENT_NAMES), "transient").otherwise(F.coalesce(by_status, F.when(error.isNotNull(), "fatal"), F.lit("ok")))


def backoff(attempt: Column, base: float = 1.0, jitter: Column | None = None) -> Column:
    """Seconds before the next try: doubled each time, and up to a quarter more by ``jitter`` in [0, 1)."""
    delay = base * F.pow(F.lit(2.0), attempt)
    return delay if jitter is None else delay * (1 + F.lit(0.25) * jitter)
