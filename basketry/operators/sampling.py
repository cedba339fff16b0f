"""Negative samples and the cart-event table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from basketry import vocab
from basketry.functions.hashing import PRIME, digest, hash28
from basketry.operators.menu import BROADCAST_ENTRIES, cap_menu, pack_pools, pool_arrays
from basketry.session import cut_lineage


def negative_pools(items: DataFrame, cap: int = vocab.MENU_CAP, seed: int = 0) -> DataFrame:
    """Per restaurant, packed: the capped menu with the hash pair and sampling weight of every item."""
    md5 = digest(F.col("item_id"), seed=seed)
    weighted = cap_menu(items, cap).withColumns({
        "weight": F.log1p(F.col("item_votes") + 1.0),
        "multiplier": hash28(md5, 1) + 1,
        "offset": hash28(md5, 8),
    })
    pools = pool_arrays(weighted.where("item_id is not null"), "item_rank", cap, [F.col("item_id").cast("long").alias("item_id"), "multiplier", "offset", "weight"])
    return pack_pools(pools, ["item_id", "multiplier", "offset", "weight"])


def draw_negatives(n: int, shared=None):
    """UDF (place, pool, item_id, cart_items, key) -> the ``n`` free items of a pool that win the exponential race.

    ``place`` names the pool: its bytes come from ``shared``, a broadcast of {place: bytes}, or else from the column ``pool``.
    Rows of an Arrow batch that share a pool are raced as one matrix of (steps, pool); the arithmetic is that of
    ``pairwise_uniform`` and ``race_key``. Self-contained, so that workers need not import this package.
    """
    prime, chunk = PRIME, 512

    def race_of(keys, multiplier, offset, weight):
        mixed = np.multiply.outer(keys, multiplier)  # below 2^57
        mixed += offset
        for _ in range(2):  # modulo 2^31 - 1: the high bits are added to the low ones
            mixed = (mixed & prime) + (mixed >> 31)
        mixed[mixed >= prime] -= prime
        race = mixed.astype("float64")
        race += 1
        race /= float(prime + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            race = np.divide(-np.log(race), weight)
        race[np.isnan(race)] = -np.inf  # no weight: first
        return race

    def draw(place: pa.Array, pool: pa.Array, item: pa.Array, cart: pa.Array, key: pa.Array) -> pa.Array:
        rows = len(place)
        where = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(cart), 0).to_numpy(zero_copy_only=False).astype("int64")
        flat = pc.list_flatten(cart)
        holder = np.repeat(np.arange(rows), sizes)[pc.is_valid(flat).to_numpy(zero_copy_only=False)]
        own = pc.fill_null(item, 0).to_numpy(zero_copy_only=False)
        # (row, item) that may not be drawn
        barred_row = np.concatenate([holder, np.arange(rows)])
        barred_item = np.concatenate([pc.drop_null(flat).to_numpy(zero_copy_only=False), own])
        order = np.argsort(barred_row, kind="stable")
        barred_row, barred_item = barred_row[order], barred_item[order]
        bars = np.concatenate([[0], np.cumsum(np.bincount(barred_row, minlength=rows))])
        open_rows = ~pc.or_(item.is_null(), cart.is_null()).to_numpy(zero_copy_only=False) & (where >= 0)
        keys = key.to_numpy(zero_copy_only=False)
        drawn = np.zeros((rows, n), "int64")
        counts = np.zeros(rows, "int64")
        sorted_rows = np.argsort(where, kind="stable")
        sorted_rows = sorted_rows[open_rows[sorted_rows]]
        for group in np.split(sorted_rows, np.flatnonzero(np.diff(where[sorted_rows])) + 1):
            if not len(group):
                continue
            packed = shared.value[int(where[group[0]])] if shared else pool[int(group[0])].as_py()
            block = np.frombuffer(packed, "int64").reshape(-1, 4)
            ids, multiplier, offset = (np.ascontiguousarray(block[:, i]) for i in range(3))
            weight = np.ascontiguousarray(block[:, 3]).view("float64")
            if not len(ids):
                continue
            listed = np.sort(ids)
            kept = min(n, len(ids))
            for at in range(0, len(group), chunk):
                some = group[at:at + chunk]
                race = race_of(keys[some], multiplier, offset, weight)
                lengths = bars[some + 1] - bars[some]
                entry = np.repeat(bars[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                barred, line = barred_item[entry], np.repeat(np.arange(len(some)), lengths)
                met = listed[np.minimum(np.searchsorted(listed, barred), len(listed) - 1)] == barred
                hit, column = np.nonzero(ids == barred[met][:, None])
                race[line[met][hit], column] = np.inf
                last = np.partition(race, kept - 1, axis=1)[:, kept - 1]
                row, column = np.nonzero((race <= last[:, None]) & (race < np.inf))
                order = np.lexsort((ids[column], race[row, column], row))
                row, column = row[order], column[order]
                turn = np.arange(len(row)) - np.searchsorted(row, row)
                row, column, turn = row[turn < n], column[turn < n], turn[turn < n]
                drawn[some[row], turn] = ids[column]
                counts[some] = np.bincount(row, minlength=len(some))
        values = drawn[np.arange(n) < counts[:, None]]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))

    return F.arrow_udf(draw, "array<bigint>")


def with_negatives(
    steps: DataFrame, items: DataFrame, n: int = vocab.NEGATIVES_PER_STEP, cap: int = vocab.MENU_CAP, seed: int = 0,
    together: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """Add ``negatives``: up to ``n`` items of the same restaurant, neither chosen nor in the cart.

    Weighted sampling without replacement by exponential race inside the row: no candidate rows
    are shuffled, and the draw depends on keys only. While pools are few a step carries the number of its pool, whose
    bytes reach every worker once. Equal values of a column ``together`` end up in one of ``tasks`` tasks: drawn steps
    move once where what follows would move every shown item.
    """
    # Hashed below the join: one digest per step, not one per candidate.
    keyed = steps.withColumn("_key", hash28(digest(F.col("session_id"), F.col("step_number"), seed=seed)))
    pools = cut_lineage(negative_pools(items, cap, seed).withColumn("_place", F.monotonically_increasing_id()))
    shared, pool = None, F.col("pool")
    if pools.count() * cap <= BROADCAST_ENTRIES:
        shared = steps.sparkSession.sparkContext.broadcast({r["_place"]: bytes(r["pool"]) for r in pools.select("_place", "pool").collect()})
        pools, pool = F.broadcast(pools.drop("pool")), F.lit(None).cast("binary")
    joined = keyed.join(pools, "restaurant_id", "left")
    drawn = draw_negatives(n, shared)(
        F.col("_place"), pool, F.col("item_id").cast("long"), F.col("cart_items").cast("array<bigint>"), F.col("_key"))
    sampled = joined.withColumn("negatives", drawn).drop("pool", "_place", "_key")
    if together:
        return sampled.repartition(tasks, together) if tasks else sampled.repartition(together)
    return sampled


def union_events(*tables: DataFrame) -> DataFrame:
    """Event tables one after another by column name; columns that a table lacks are null.

    Nothing is shuffled; ``repeated_events`` finds events that two tables share.
    """
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), tables)


def repeated_events(events: DataFrame, key: tuple[str, ...] = ("session_id", "step_number", "candidate_item")) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)


def cart_events(steps: DataFrame, items: DataFrame, **sampling) -> DataFrame:
    """One row per shown item: the added one (label 1) and its negatives (label 0)."""
    return shown_items(with_negatives(steps, items, **sampling))


def shown_items(sampled: DataFrame, labels: tuple[int, ...] = (1, 0)) -> DataFrame:
    """One row per item that a step with its ``negatives`` shows; ``labels`` 1 the added one, 0 the others."""
    positive = F.array(F.struct(F.col("item_id").alias("candidate_item"), F.lit(1).alias("label")))
    negative = F.transform(
        "negatives", lambda x: F.struct(x.alias("candidate_item"), F.lit(0).alias("label"))
    )
    shown = sampled.withColumn("_shown", F.explode(F.concat(*[{1: positive, 0: negative}[label] for label in labels])))
    kept = [c for c in sampled.columns if c not in ("item_id", "item_category", "price", "negatives")]
    return shown.select(*kept, F.col("_shown.candidate_item"), F.col("_shown.label"))
