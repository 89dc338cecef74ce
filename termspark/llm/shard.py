"""Sharding by sampled splitters.

Records are ordered by a hash of their key (here: the text, so equal texts are
neighbours) and, inside a key, by a hash of their id.  A size-weighted sample of
the keys (each record with a chance in proportion to its size) gives
quantile boundaries, the splitters; they cut the order into many ranges of like
weight, each of which one task can hold.  A key that fills more than one range
is drawn more than once, and its range is cut inside the key.  Ranges that the
exact totals show to be overfull are sampled again and subdivided.

With the ranges' totals every record knows its place in the whole order, and the
place in bytes gives the shard: shard k takes the records whose middle falls
into the k-th of ``shards`` equal parts of all bytes.  A key is kept in one shard
as long as its records together are no larger than the largest record of all, or than
``whole`` of a shard.  So the law is ``bytes``: shard sizes differ by little more than
two records of the largest size do.

Only the splitters and the totals of the ranges (bounded by ``max_ranges``)
reach the driver.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspark.llm.common import materialize

#: Samples drawn for each range.
OVERSAMPLE = 16
#: Records meant for a range, and the most ranges.
RANGE_ROWS, MAX_RANGES = 200_000, 50_000
#: A key's records stay together up to this share of a shard.
WHOLE = 1 / 128


def sample_splitters(df: DataFrame, ranges: int, mean: float, weight: float) -> list[tuple[int, int]]:
    """At most ``ranges`` - 1 boundaries (key, sub) of ranges of like weight.

    A record of weight w is drawn when w / u exceeds ``weight`` / m, u uniform in
    (0, 1] from its hash: with probability in proportion to w, all together about
    m = ``ranges`` * OVERSAMPLE of them, which is all that reaches the driver."""
    # the record's size plus the mean size, so that both bytes and rows of a range are bounded
    u = (F.pmod(F.xxhash64(F.lit(11), "_key", "_sub"), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    w = F.col("size").cast("double") + F.lit(mean)
    tau = weight / (ranges * OVERSAMPLE)
    rows = df.where(w / u > tau).select("_key", "_sub", w.alias("w")).collect()
    if not rows:
        return []
    rows = sorted((r["_key"], r["_sub"], max(r["w"], tau)) for r in rows)
    total, out, acc, step = sum(r[2] for r in rows), [], 0.0, 1
    for k, s, weight in rows:
        acc += weight
        while step < ranges and acc >= total * step / ranges:
            if not out or out[-1] != (k, s):
                out.append((k, s))
            step += 1
    return _cut_keys(out)


def _cut_keys(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A key drawn once is cut before its first record, so it stays whole; one that
    was drawn several times is cut inside as well."""
    low = -(1 << 63)
    return sorted({(k, s if i and cuts[i - 1][0] == k else low) for i, (k, s) in enumerate(cuts)})


def _ranged(df: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Adds ``_range``: the number of splitters at or before the record."""
    keys, subs = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
    sent = df.sparkSession.sparkContext.broadcast((keys, subs))

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        keys, subs = sent.value
        for k, s in it:
            k, s = k.to_numpy(), s.to_numpy()
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            at, out = np.flatnonzero(hi > lo), lo.copy()  # the key itself is a splitter: the id decides
            for x in np.unique(lo[at]):
                own = at[lo[at] == x]
                out[own] = x + np.searchsorted(subs[x:hi[own[0]]], s[own], "right")
            yield pd.Series(out)

    return df.withColumn("_range", F.pandas_udf(run, "long")("_key", "_sub"))


def assign_shards(records: DataFrame, shards: int, *, key: str, size: str, tie: list[str],
                  whole: float = WHOLE, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """The columns of ``records`` plus law, shard (0 to shards - 1) and slot (the
    record's place in its shard, 0, 1, ...).

    ``key`` names the column whose equal values are kept together (up to the size of the
    largest record, or ``whole`` of a shard if that is more), ``size`` the
    bytes of a record (null or negative: 0), ``tie`` the columns that order the
    records of one key.  Nulls are a key like any other; records that are equal
    in all of these take any order among themselves; an empty table stays
    empty.  Columns named like the added ones are replaced.
    """
    keep = [c for c in records.columns if c not in ("law", "shard", "slot")]
    base = records.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.xxhash64(F.col(f"`{key}`")).alias("_key"), F.xxhash64(*[F.col(f"`{c}`") for c in tie]).alias("_sub"))
    base = materialize(base)
    n, total, largest = base.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    law = F.lit("bytes").alias("law")
    if not n:
        return base.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], law,
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total = total or 0
    mean = max(total / n, 1.0)
    ranges = min(max_ranges, max(4 * shards, -(-n // range_rows)))
    cuts = sample_splitters(base, ranges, mean, total + n * mean)
    most = 2.0 * (total + n * mean) / ranges
    for attempt in range(4):
        placed = _ranged(base, cuts)
        stats = {r["_range"]: (r["b"], r["n"]) for r in
                 placed.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        over = [k for k, (b, c) in stats.items() if b + c * mean > most and c > 1]
        if not over or attempt == 3:
            break
        heavy = sum(stats[k][0] + stats[k][1] * mean for k in over)
        parts = 2 * (int(heavy / most) + 2 * len(over))
        more = sample_splitters(placed.where(F.col("_range").isin(over)), min(parts, max_ranges), mean, heavy)
        if set(more) <= set(cuts):
            break
        cuts = sorted(set(cuts) | set(more))
    ids = sorted(stats)
    before, rank, rows = 0, 0, []
    for k in ids:
        rows.append((k, before, rank))
        before, rank = before + stats[k][0], rank + stats[k][1]
    offsets = records.sparkSession.createDataFrame(rows, "_range long, _bytes long, _rank long")
    order = Window.partitionBy("_range").orderBy("_key", "_sub", *[F.col(f"c{keep.index(c)}") for c in tie])
    group = Window.partitionBy("_range", "_key")
    bound = max(whole * total / shards, largest or 0)
    # a key that is cut inside begins at a splitter; such keys are fewer than the splitters
    low, first_byte = -(1 << 63), {k: b for k, b, _ in rows}
    inside = {k for k, sub in cuts if sub != low}
    begins = [(k, first_byte.get(i + 1, 0)) for i, (k, sub) in enumerate(cuts) if sub == low and k in inside]
    large = F.broadcast(records.sparkSession.createDataFrame(begins, "_key long, _kbytes long"))
    large = large.join(base.join(large, "_key", "left_semi").groupBy("_key").agg(F.sum("size").alias("_ksize")), "_key")
    rowed = (placed.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_no", F.row_number().over(order) - 1)
             .withColumn("_gsize", F.sum("size").over(group)).withColumn("_gstart", F.min(F.col("_end") - F.col("size")).over(group)))
    group_size, group_start = F.coalesce("_ksize", "_gsize"), F.coalesce(F.col("_kbytes"), F.col("_bytes") + F.col("_gstart"))
    middle = F.when(group_size <= F.lit(bound), group_start + group_size / 2).otherwise(F.col("_bytes") + F.col("_end") - F.col("size") / 2)
    shard = F.floor(middle * F.lit(float(shards)) / F.lit(float(max(total, 1)))).cast("int")
    out = materialize(
        rowed.join(F.broadcast(offsets), "_range").join(F.broadcast(large), "_key", "left")  # bounded by max_ranges
        .withColumn("shard", F.least(F.greatest(shard, F.lit(0)), F.lit(shards - 1)))
        .withColumn("_at", F.col("_rank") + F.col("_no"))
        .select(*[f"c{i}" for i in range(len(keep))], "shard", "_at"))
    starts = out.groupBy("shard").agg(F.min("_at").alias("_start"))
    return (out.join(F.broadcast(starts), "shard")  # one row a shard
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], law, "shard", (F.col("_at") - F.col("_start")).alias("slot")))


def write_shards(records: DataFrame, shards: int, path: str, **how) -> None:
    """Writes the records, one folder ``shard=k`` for each shard, rows by slot; what holds for
    :func:`assign_shards` of nulls, ties and repeated rows holds here, and an empty table
    writes no folder."""
    out = assign_shards(records, shards, **how)
    out.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
