"""Join-then-SUM shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.unsigned import wrapped, wrapping_sum


def sums(df: DataFrame, *columns: str) -> DataFrame:
    """One row s0..sN: the wrapping SUM of each column; NULL where df has no rows."""
    return df.agg(*(wrapping_sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)))


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Unconnected components are summed independently: their single rows in one row, renumbered."""
    names = [[f"p{i}_{c}" for c in p.columns] for i, p in enumerate(parts)]
    one = reduce(lambda a, b: a.join(b, F.lit(True)), (p.toDF(*n) for p, n in zip(parts, names, strict=True)))
    return one.toDF(*(f"s{i}" for i in range(len(one.columns))))


def many_to_many_sums(left: DataFrame, left_key: str, left_value: str, right: DataFrame, right_key: str, right_value: str) -> DataFrame:
    """SUM of both values over an equi-join, without making its rows.

    Each side becomes one row a key (count, sum) before the join, so the work is
    linear even where a key holds a large part of both sides.
    """

    def per_key(df: DataFrame, key: str, value: str, p: str) -> DataFrame:
        return df.groupBy(F.col(key).alias(f"{p}k")).agg(F.count(F.lit(1)).alias(f"{p}n"), F.sum(F.col(value).cast("decimal(20,0)")).alias(f"{p}s"))

    j = per_key(left, left_key, left_value, "l").join(per_key(right, right_key, right_value, "r"), F.col("lk") == F.col("rk"))
    modulus = F.expr("18446744073709551616BD")

    def times(a: str, b: str):
        return F.sum(F.pmod(F.pmod(F.col(a), modulus).cast("decimal(20,0)") * F.col(b).cast("decimal(18,0)"), modulus).cast("decimal(20,0)"))

    return j.agg(wrapped(times("ls", "rn")).alias("s0"), wrapped(times("rs", "ln")).alias("s1"))
