"""Tolerant as-of join: each click's latest order, ties told apart and counted.

Orders are collapsed first, with partial sums on the map side, to the winner and the number of
orders of each client and time. Winners and clicks are one table, sorted by client, time,
orders before clicks; going along a client's rows, the last order seen is the match.

The sort is a range partitioning by client, time, kind and id, so that a client with a third of
all rows lies over a third of the partitions. A partition hands on one row, the last order of
its last client; a client's clicks ahead of their partition's first order take the latest of
these rows from a partition before. Nothing but these rows, one of each partition, is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, stored

HOUR_US = 3_600_000_000
SETTLED, OPEN, TAIL = 0, 1, 2
_OUT = [("pid", "int"), ("state", "int"), ("id", "long"), ("client", "long"), ("us", "long"), ("o_us", "long"), ("sale", "long"), ("cents", "long"), ("tied", "long")]


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def winners(orders: DataFrame) -> DataFrame:
    """(client, us, id, cents, tied) of orders (client, us, sale, priority, cents): one row for each client and time.

    The smaller priority wins, then the larger sale, then the larger sum; null loses. Orders
    without client or time are left out.
    """
    best = F.max(F.struct((-F.col("priority").cast("long")).alias("p"), "sale", "cents"))
    some = orders.where("client is not null and us is not null").groupBy("client", "us").agg(best.alias("b"), F.count(F.lit(1)).alias("tied"))
    return some.select("client", "us", F.col("b.sale").alias("id"), F.col("b.cents").alias("cents"), "tied")


def _walk(batches):
    """Along sorted rows (client, us, kind, id, cents, tied): every click with the last order before it, and the partition's tail."""
    pid = TaskContext.get().partitionId()
    carry, first, last = None, None, None  # the last order (client, us, sale, cents, tied), the first client, the last one

    def out(state, columns):
        n = len(columns[0])
        head = [pa.array(np.full(n, pid, np.int32)), pa.array(state.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*head, *columns], names=[c for c, _ in _OUT])

    for batch in batches:
        if not batch.num_rows:
            continue
        client, us, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        first, last = client[0] if first is None else first, client[-1]
        if carry is not None:  # in front of this batch's own rows
            client, us, kind = np.r_[carry[0], client], np.r_[carry[1], us], np.r_[0, kind]
        sale, cents, tied = (pa.concat_arrays([pa.array([carry[i]], pa.int64()), batch.column(j)]) if carry is not None else batch.column(j) for i, j in ((2, 3), (3, 4), (4, 5)))
        at = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
        clicks = np.flatnonzero(kind == 1)
        hit = at[clicks]
        none = (hit < 0) | (client[hit] != client[clicks])
        take = pa.array(np.where(none, 0, hit), mask=none)
        state = np.where(none & (client[clicks] == first), OPEN, SETTLED)
        yield out(state, [sale.take(pa.array(clicks)), pa.array(client[clicks]), pa.array(us[clicks]), pa.array(us).take(take), sale.take(take), cents.take(take), tied.take(take)])
        if at[-1] >= 0:
            i = int(at[-1])
            carry = (int(client[i]), int(us[i]), *(x[i].as_py() for x in (sale, cents, tied)))
    if carry is not None and carry[0] == last:
        one = [pa.array([x], pa.int64()) for x in (None, carry[0], None, *carry[1:])]
        yield out(np.array([TAIL]), one)


def matches(clicks: DataFrame, orders: DataFrame, tolerance_us: int) -> DataFrame:
    """(id, client, us, sale, lag_us, cents, tied) for every row of clicks (id, client, us).

    ``orders`` are (client, us, sale, priority, cents), all long or int. The match is the
    client's latest order at or before the click and at most ``tolerance_us`` earlier (both ends
    included). Nulls: no client or no time, no match (tied 0, the others null). Repeated clicks
    are answered as often as they occur; repeated orders all count in ``tied``. Empty tables give
    no rows, or rows without match. Columns of other names aren't read.
    """
    spark = clicks.sparkSession
    rows = clicks.select(F.col("client").cast("long"), F.col("us").cast("long"), F.col("id").cast("long"))
    known = F.col("client").isNotNull() & F.col("us").isNotNull()
    void = F.lit(None).cast("long")
    left = rows.where(known).select("client", "us", F.lit(1).alias("kind"), "id", void.alias("cents"), void.alias("tied"))
    right = winners(orders).select(F.col("client").cast("long"), F.col("us").cast("long"), F.lit(0).alias("kind"), F.col("id").cast("long"), F.col("cents").cast("long"), "tied")
    order = ["client", "us", "kind", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = right.unionByName(left).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    walked = stored(map_batches(dealt, _walk, ", ".join(f"{c} {t}" for c, t in _OUT)), "asof-walked")

    # one tail and one open client of a partition at most: the latest tail before it is its match
    tails = walked.where(F.col("state") == TAIL).select("client", "pid", F.struct("o_us", "sale", "cents", "tied").alias("order"))
    heads = walked.where(F.col("state") == OPEN).groupBy("client", "pid").agg(F.lit(None).cast(tails.schema["order"].dataType).alias("order"), F.lit(True).alias("head"))
    before = Window.partitionBy("client").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    both = tails.withColumn("head", F.lit(False)).unionByName(heads).groupBy("client", "pid").agg(F.max("order").alias("order"), F.bool_or("head").alias("head"))
    carried = both.withColumn("carry", F.last("order", ignorenulls=True).over(before)).where("head").select("pid", "carry")

    settled = walked.where(F.col("state") == SETTLED).select("id", "client", "us", "o_us", "sale", "cents", "tied")
    opened = walked.where(F.col("state") == OPEN).select("pid", "id", "client", "us").join(F.broadcast(carried), "pid", "left").select("id", "client", "us", "carry.*")
    lag = F.col("us") - F.col("o_us")
    fits = lag <= tolerance_us
    found = settled.unionByName(opened).select("id", "client", "us", *(F.when(fits, c).alias(a) for a, c in (("sale", F.col("sale")), ("lag_us", lag), ("cents", F.col("cents")))), F.when(fits, F.col("tied")).otherwise(F.lit(0)).cast("long").alias("tied"))
    without = rows.where(~known).select("id", "client", "us", *(void.alias(c) for c in ("sale", "lag_us", "cents")), F.lit(0).cast("long").alias("tied"))
    return found.unionByName(without)


def _floored(time: str, id_: str) -> Column:
    """The time in microseconds, floored to the hour where the crc32 of the id's digits is odd."""
    us = micros(F.col(time))
    return F.when(F.crc32(F.col(id_).cast("string")) % 2 == 1, us - F.pmod(us, F.lit(HOUR_US))).otherwise(us)


def clicks_to_orders(clicks: DataFrame, sales: DataFrame, tolerance_hours: int = 240) -> DataFrame:
    """Every click_id once, with the order of its client that it matches.

    Two of three sales bring a second order of the same time. Copies of a click are rows of one
    click_id; where they differ, the greatest client and the greatest time count. Clicks without
    click_id are copies of one another.
    """
    own = sales.select("client_id", "sale_id", "priority", "total", _floored("sold_at", "sale_id").alias("us"), F.crc32(F.col("sale_id").cast("string")).alias("h"))
    both = F.array(F.struct("sale_id", "priority"), F.when(F.col("h") % 3 != 0, F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))))
    cents = F.floor(100 * F.col("total") + 0.5).cast("long")
    orders = own.select(F.col("client_id").alias("client"), "us", cents.alias("cents"), F.explode(F.array_compact(both)).alias("o")).select("client", "us", "cents", F.col("o.sale_id").alias("sale"), F.col("o.priority").alias("priority"))
    once = clicks.select("click_id", "client_id", _floored("ts", "click_id").alias("us")).groupBy("click_id").agg(F.max("client_id").alias("client"), F.max("us").alias("us"))
    out = matches(once.select(F.col("click_id").alias("id"), "client", "us"), orders, tolerance_hours * HOUR_US)
    return out.select(F.col("id").alias("click_id"), F.col("client").alias("client_id"), F.col("us").alias("ts_us"), F.col("sale").alias("sale_id"), "lag_us", F.col("cents").alias("total_cents"), F.col("tied").alias("n_tied"))
