"""Ranges of rows in the order of a key and a tie, for global orders without a single task.

Nulls of the key come first. A key value with very many rows, null included, is cut further by the tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bound: whether the key is not null, the key (0 for null), the tie from which on rows lie above.
Bound = tuple[bool, int, int]
LEAST = -(1 << 63)


def range_bounds(df: DataFrame, key: str, tie: str, ranges: int) -> list[Bound]:
    """Ascending bounds of about equally many rows: some `ranges` numbers come to the driver, however many rows."""
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    quantiles = F.percentile_approx(key, shares, 10 * ranges).alias("q")
    row = df.agg(quantiles, F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    found = row["q"] or []
    bounds: set[Bound] = {(True, v, LEAST) for v in found}
    many = sorted({v for v in found if found.count(v) > 1})
    heavy = F.col(key).isin(many) if many else F.lit(False)
    if row["nulls"] * ranges > row["n"]:
        heavy = heavy | F.col(key).isNull()
        many.append(None)
    if many:
        ties = F.percentile_approx(tie, shares, 10 * ranges).alias("q")
        for r in df.where(heavy).groupBy(key).agg(ties, F.count(F.lit(1)).alias("n")).collect():
            parts = max(1, round(r["n"] * ranges / row["n"]))
            cuts = {r["q"][min(len(shares) - 1, i * ranges // parts - 1)] for i in range(1, parts)}
            bounds |= {(r[key] is not None, r[key] or 0, t) for t in cuts}
    return sorted(bounds)


def range_of(key: str, tie: str, bounds: list[Bound]) -> Column:
    """The number of bounds at or below the row."""
    if not bounds:
        return F.lit(0)
    seen, value = f"{key} is not null", f"coalesce({key}, 0L)"
    literal = lambda x: "(-9223372036854775807L - 1L)" if x == LEAST else f"({x}L)"
    listed = ",".join(f"struct({str(s).lower()} as s, {literal(k)} as k, {literal(t)} as t)" for s, k, t in bounds)
    return F.expr(f"size(filter(array({listed}), b -> b <= struct({seen} as s, {value} as k, {tie} as t)))").cast("int")
