"""Reconciliation under three-valued logic: sums that a null poisons, row conventions, identities, missing operands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_sum(c: Column) -> Column:
    """The sum of a group, null if the group is empty or any value is missing."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(c)), F.sum(c))


def all_true(c: Column) -> Column:
    """True only if each value is true; a null counts as not true."""
    return F.every(F.coalesce(c, F.lit(False)))


def only_value(c: Column) -> Column:
    """The value of a group that has exactly one distinct value."""
    return F.when(F.count_distinct(c) == 1, F.max(c))


def upper_median(c: Column) -> Column:
    """The element at n div 2 of the sorted values, not the mean of two."""
    got = F.sort_array(F.collect_list(c))
    return F.get(got, F.floor(F.size(got) / 2).cast("int"))


def status(expected: Column, actual: Column, tolerance: float) -> Column:
    return F.when(expected.isNull() | actual.isNull(), "unresolved").when(F.abs(expected - actual) <= tolerance, "ok").otherwise("mismatch")


def missing(**operands: Column) -> Column:
    """Names of the operands that are null, comma-joined in the order given."""
    return F.concat_ws(",", *(F.when(c.isNull(), F.lit(n)) for n, c in operands.items()))


def reconciled(totals: DataFrame, items: DataFrame, key: str, amount: str, printed: str, tolerance: float = 5) -> DataFrame:
    """totals with n_items, summed and status; items are reduced by key before the join."""
    sums = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), complete_sum(F.col(amount)).alias("summed"))
    out = totals.join(sums, key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
    return out.withColumn("status", status(F.col("summed"), F.col(printed), tolerance))


def row_mode(q: Column, p: Column, amount: Column, vat: Column, gross: Column, discount: Column, tolerance: float = 2) -> Column:
    """direct: q p - d = amount and amount + vat = gross; per_unit: price = amount and q (amount + vat) - d = gross."""
    near = lambda a, b: F.abs(a - b) <= tolerance
    d = F.coalesce(discount, F.lit(0))
    direct = near(q * p - d, amount) & F.coalesce(near(amount + vat, gross), F.lit(True))
    unit = near(p, amount) & near(q * (amount + vat) - d, gross)
    return F.when(q.isNull() | p.isNull() | amount.isNull(), "unresolved").when(direct, "direct").when(unit, "per_unit").otherwise("mismatch")


def plausible(q: Column, p: Column, a: Column, v: Column, g: Column, tolerance: float = 5, far: float = 100) -> Column:
    """False only if all five are known, no identity holds, and both the row total and the price are far off."""
    known = q.isNotNull() & p.isNotNull() & a.isNotNull() & v.isNotNull() & g.isNotNull()
    holds = (F.abs(a - p) <= tolerance) | (F.abs(q * p - a) <= tolerance) | (F.abs(a + v - g) <= tolerance)
    return ~F.coalesce(known & ~holds & (F.abs(q * p - g) > far) & (F.abs(a - p) > far), F.lit(False))
