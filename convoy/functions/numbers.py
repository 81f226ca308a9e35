"""Scores, prices and guarded arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prices in USD for a million tokens, and the weights of scores.
PRICING = {"input": 0.075, "output": 0.30}
IMPACT = {"low": 1.0, "medium": 2.5, "high": 4.0, "critical": 6.0}
COMPLEXITY = {"easy": 3.0, "moderate": 2.0, "complex": 1.0}


def token_cost(tokens_in: Column, tokens_out: Column, pricing: dict[str, float] = PRICING) -> Column:
    return tokens_in / 1e6 * pricing["input"] + tokens_out / 1e6 * pricing["output"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_even(c: Column, places: int = 0) -> Column:
    """Rounded, halves to the even neighbour."""
    return F.bround(c, places)


def change_percent(new: Column, old: Column) -> Column:
    return F.when(old != 0, (new - old) / old * 100).otherwise(0.0)


def budget_status(percent: Column) -> Column:
    return F.when(percent >= 95, "critical").when(percent >= 75, "warning").when(percent >= 50, "caution").otherwise("healthy")


def efficiency_score(cost_per_item: Column, tokens_per_second: Column) -> Column:
    return 0.6 / (1 + 100 * cost_per_item) + 0.4 * F.least(tokens_per_second / 200, F.lit(1.0))


def utilisation_score(workers: Column) -> Column:
    """Best at four workers, never under a half beyond."""
    return F.when(workers <= 4, workers / 4.0).otherwise(F.greatest(F.lit(0.5), 1 - (workers - 4) * 0.1))


def health_score(efficiency: Column, reliability: Column, cost: Column) -> Column:
    half = F.lit(0.5)
    return 0.4 * F.coalesce(efficiency, half) + 0.3 * F.coalesce(reliability, half) + 0.3 * F.coalesce(cost, half)


def _lookup(c: Column, table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def priority_score(impact: Column, complexity: Column, confidence: Column, saving: Column, risks: Column) -> Column:
    return F.greatest(F.lit(0.0), _lookup(impact, IMPACT) * _lookup(complexity, COMPLEXITY) * confidence + F.least(saving / 100, F.lit(2.0)) - 0.2 * risks)


def effect_label(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")


def retry_delay(attempt: int, base: float = 1.0, most: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds before another try: doubled each time, with at most an eighth of jitter."""
    delay = min(base * 2**attempt, most)
    return max(0.1, delay + delay * 0.25 * (min(max(jitter, 0.0), 1.0) - 0.5) if jitter else delay)


def retry_delays(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """As `retry_delay` without jitter, for a column of attempts."""
    return F.greatest(F.lit(0.1), F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)))


def error_kind(message: Column, kind: Column | None = None) -> Column:
    """The class of an error by its message, the first rule that fits; `kind` is the
    name of its type, if known."""
    low = F.lower(message)
    has = lambda w: F.contains(low, F.lit(w))
    typed = F.lit(False) if kind is None else F.coalesce(kind.isin("ValueError", "TypeError"), F.lit(False))
    return (
        F.when(has("quota") | has("rate limit"), "RATE_LIMIT_EXCEEDED")
        .when(has("timeout") | has("timed out"), "TIMEOUT")
        .when(has("connection") | has("network"), "CONNECTION_ERROR")
        .when(has("json") & has("decode"), "JSON_DECODE_ERROR")
        .when(has("internal") | has("server error"), "INTERNAL_ERROR")
        .when(typed, "VALIDATION_ERROR")
        .otherwise("UNKNOWN_ERROR")
    )


def retryable(kind: Column) -> Column:
    return kind.isin("RATE_LIMIT_EXCEEDED", "TIMEOUT", "CONNECTION_ERROR", "INTERNAL_ERROR", "JSON_DECODE_ERROR")
