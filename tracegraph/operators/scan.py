"""Running values over rows in order, for keys of any size.

A window over a key is one task. Here a key's rows are cut into buckets of ``width`` order values; each bucket is scanned alone, the buckets' summaries (a row each) are
scanned in order, and what comes in from the buckets before is carried back to a bucket's rows. A key with 10^8 rows is 10^8 / width tasks, and its summaries
are as many rows. Bucket and carry meet on the same keys that the window was dealt by, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WIDTH = 1 << 16


class Running(NamedTuple):
    """A value of each row that adds up over rows: inside a bucket (over an ordered window), of a whole bucket (an aggregate, given the order), of the buckets before
    or behind (over an ordered window of summaries), and both put together."""

    inside: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def _upto(w: WindowSpec, last: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, last)


def running_sum(value: Column) -> Running:
    """The sum of all rows up to this one; nulls count nothing."""
    v = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    return Running(lambda w: F.sum(v).over(_upto(w)), lambda _: F.sum(v), lambda s, w: F.sum(s).over(_upto(w, -1)), lambda c, x: F.coalesce(c, F.lit(0)) + x)


def last_value(value: Column) -> Running:
    """The last value that is not null, of this row or one before."""
    return Running(
        lambda w: F.last(value, ignorenulls=True).over(_upto(w)), lambda at: F.max_by(value, F.when(value.isNotNull(), at)),
        lambda s, w: F.last(s, ignorenulls=True).over(_upto(w, -1)), lambda c, x: F.coalesce(x, c),
    )


def row_before(value: Column) -> Running:
    """The value of the row before, null included; null in the first row."""
    v = F.struct(value.alias("v"))
    return Running(lambda w: F.lag(v).over(w), lambda at: F.max_by(v, at), lambda s, w: F.last(s, ignorenulls=True).over(_upto(w, -1)), lambda c, x: F.coalesce(x, c)["v"])


def row_after(value: Column) -> Running:
    """The value of the row behind, null included; null in the last row."""
    v = F.struct(value.alias("v"))
    behind = lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return Running(lambda w: F.lead(v).over(w), lambda at: F.min_by(v, at), behind, lambda c, x: F.coalesce(x, c)["v"])


def scan(rows: DataFrame, by: list[str], order: str, values: dict[str, Running], width: int = WIDTH) -> DataFrame:
    """``rows`` with a column for each of ``values``, running over each key's rows by ``order``, a whole number that is unique in its key.

    Rows without an order value form a bucket of their own in front. Keys may hold nulls; null keys are one key. An empty table gives none.
    """
    key, bucket = F.struct(*by).alias("_key"), F.floor(F.col(order) / width).alias("_bucket")
    # a struct is never null, so that the window and the join are dealt by the same two columns
    dealt = rows.withColumns({"_key": key, "_bucket": F.coalesce(bucket, F.lit(-(1 << 62)))})
    inside = Window.partitionBy("_key", "_bucket").orderBy(order)
    local = dealt.withColumns({f"_in_{c}": v.inside(inside) for c, v in values.items()})
    sums = dealt.groupBy("_key", "_bucket").agg(*(v.summary(F.coalesce(F.col(order), F.lit(0))).alias(f"_sum_{c}") for c, v in values.items()))
    across = Window.partitionBy("_key").orderBy("_bucket")
    carry = sums.select("_key", "_bucket", *(v.carried(F.col(f"_sum_{c}"), across).alias(f"_c_{c}") for c, v in values.items()))
    # a summary a key or bucket may be as many rows as there are: never through the driver
    out = local.join(carry.hint("merge"), ["_key", "_bucket"], "left")
    return out.select(*rows.columns, *(v.joined(F.col(f"_c_{c}"), F.col(f"_in_{c}")).alias(c) for c, v in values.items()))


def trailing_count(rows: DataFrame, by: list[str], order: str, n: int, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with how many rows of their key have an order value in the ``n`` up to theirs.

    A bucket of at least ``4 * n`` values also gets the last ``n - 1`` values of the one before, so nothing need be carried; at most a quarter of the rows is sent twice.
    """
    width = max(width, 4 * n)
    own = F.floor(F.col(order) / width)
    also = F.when(F.col(order) - own * width > width - n, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy(*by, "_bucket").orderBy(order).rangeBetween(-(n - 1), 0)
    return rows.withColumn("_bucket", F.explode(also)).withColumn(name, F.count("*").over(w)).where(F.col("_bucket") == own).drop("_bucket")
