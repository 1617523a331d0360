"""Statuses, quarantine gates, tallies, budgets and work planning."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a step's status, the strongest first.
STATUSES = ("skipped", "error", "failed", "passed", "measured")
RAN = ("passed", "failed", "measured")
LEAST_BUDGET = 8


def status(skipped: Column, error: Column, verdict: Column) -> Column:
    """Status of a step from whether it was skipped, its error and its verdict."""
    return F.when(skipped, "skipped").when(error.isNotNull(), "error").when(verdict == False, "failed").when(verdict == True, "passed").otherwise("measured")  # noqa: E712


def gate(steps: DataFrame, *, keys=("episode_id",), order: str = "step_order") -> DataFrame:
    """Adds ``status`` to ``steps(..., critical, verdict, error)``: what follows the first
    critical failure of an episode is skipped.
    """
    failed = F.when(F.col("critical") & (F.col("verdict") == False), F.col(order))  # noqa: E712
    first = F.min(failed).over(Window.partitionBy(*keys))
    return steps.withColumn("status", status(F.coalesce(F.col(order) > first, F.lit(False)), F.col("error"), F.col("verdict")))


def tally(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Errors, quarantined and processed episodes, each counted once in that precedence."""
    kind = F.when(F.col("errors") > 0, "error").when(F.col("quarantined"), "quarantined").otherwise("processed")
    count = lambda k: F.sum((kind == k).cast("bigint")).alias(k)
    return outcomes.groupBy(*keys).agg(count("processed"), count("quarantined"), count("error"), F.count("*").alias("total"))


def budget(total: Column, share: float = 0.01) -> Column:
    """Failures that a stage of ``total`` episodes may have."""
    return F.greatest(F.lit(LEAST_BUDGET), F.ceil(F.lit(share) * total)).cast("bigint")


def enforce(tallied: DataFrame, *, quarantine: bool = False) -> None:
    """Raises if a tally is over its error budget or holds errors alone; with ``quarantine`` also if too many are quarantined.

    Checks decide quarantine, so only their stage asks for that.
    """
    if quarantine and (held := tallied.where(F.col("quarantined") > budget(F.col("total"))).limit(1).collect()):
        raise RuntimeError(f"{held[0]['quarantined']} of {held[0]['total']} episodes are quarantined")
    over = tallied.where((F.col("error") > budget(F.col("total"))) | ((F.col("error") == F.col("total")) & (F.col("total") > 0))).limit(1).collect()
    if over:
        raise RuntimeError(f"{over[0]['error']} of {over[0]['total']} episodes failed")


def by_count(count: int) -> Callable[[], Callable[[int], int]]:
    """A pack for ``plan``: always the lightest of ``count`` lanes, of equal ones the lower number."""

    def fresh() -> Callable[[int], int]:
        heap = [(0, k) for k in range(count)]

        def lane(size: int) -> int:
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            return k

        return lane

    return fresh


def by_bytes(target: int) -> Callable[[], Callable[[int], int]]:
    """A pack for ``plan``: the first lane with room; a size over the target alone.

    The room of the lanes is a tree of maxima, so a lane is found in as many steps as
    their number has bits; eight to sixteen bytes a lane, doubled as lanes are opened, are all that is held.
    """

    def fresh() -> Callable[[int], int]:
        tree, leaves, used = array("q", [-1, -1]), 1, 0

        def lane(size: int) -> int:
            nonlocal tree, leaves, used
            if tree[1] < size or tree[1] < 0:  # none of the lanes in use has room
                if used == leaves:
                    tree = _doubled(tree, leaves)
                    leaves *= 2
                k, used = used, used + 1
                room = target - size
            else:
                at = 1
                while at < leaves:
                    at = 2 * at if tree[2 * at] >= size else 2 * at + 1
                k = at - leaves
                room = tree[at] - size
            at = leaves + k
            tree[at] = room
            while at > 1:
                at //= 2
                tree[at] = max(tree[2 * at], tree[2 * at + 1])
            return k

        return lane

    return fresh


def _doubled(tree: array, leaves: int) -> array:
    """The tree of maxima over twice as many leaves, the new ones without room."""
    wide = array("q", [-1]) * (4 * leaves)
    wide[2 * leaves : 3 * leaves] = tree[leaves : 2 * leaves]
    for at in range(2 * leaves - 1, 0, -1):
        wide[at] = max(wide[2 * at], wide[2 * at + 1])
    return wide


def lanes(sizes: Iterable[int], pack: Callable[[], Callable[[int], int]]) -> list[int]:
    """Lane of each size, in the order given."""
    return list(map(pack(), sizes))


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, fresh: Callable[[], Callable[[int], int]], out: str) -> DataFrame:
    """Adds ``out``: what a function made afresh for each key says to the sizes in order.

    Spark sorts the keys' streams; a task holds a batch and the function's state, never a whole key.
    """
    at, places = rows.columns.index(size), [rows.columns.index(c) for c in keys]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, None
        for batch in batches:
            found = []
            for name, s in zip(zip(*(batch.column(k).to_pylist() for k in places)), batch.column(at).to_pylist()):
                if number is None or name != now:
                    now, number = name, fresh()
                found.append(number(s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, out])

    ddl = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(over, f"{ddl}, `{out}` int")


def _sized(size: str) -> Column:
    return F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size)


def deal(items: DataFrame, pack: Callable[[], Callable[[int], int]], *, key: str, item: str, size: str) -> DataFrame:
    """``(key, item, size, batch)``: the batch of each item, a row each.

    Items of a key go to lanes one by one, the largest first and of equal ones the smaller
    item; which lane the next gets depends on all before it, so a key is one task's sorted
    stream, of which the lanes' loads are held. Batches are numbered by total size, the largest first, then by
    their least item. A null size counts as 0, a null item comes last; equal rows are items each.
    """
    packed = _numbered(items.select(key, item, _sized(size)), [key], [F.desc(size), F.asc_nulls_last(item)], size, pack, "lane")
    totals = packed.groupBy(key, "lane").agg(F.sum(size).alias("total"), F.min(item).alias("least"))
    w = Window.partitionBy(key).orderBy(F.desc("total"), F.asc_nulls_last("least"), "lane")
    numbered = totals.select(F.col(key).alias("_key"), F.col("lane").alias("_lane"), (F.row_number().over(w) - 1).alias("batch"))
    return packed.join(numbered, F.col(key).eqNullSafe(F.col("_key")) & (F.col("lane") == F.col("_lane"))).select(key, item, size, "batch")


def plan(items: DataFrame, pack: Callable[[], Callable[[int], int]], *, key: str, item: str, size: str, stagger_s: float = 2.0) -> DataFrame:
    """Batches of each key's items: (key, batch, items, total_bytes, start_delay_s).

    ``deal`` with a row per batch that lists its items, which is what a scheduler takes; where batches
    hold more items than a row should, use the rows of ``deal``.
    """
    packed = _numbered(items.select(key, item, _sized(size)), [key], [F.desc(size), F.asc_nulls_last(item)], size, pack, "lane")
    batches = packed.groupBy(key, "lane").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(size).alias("total_bytes"))
    w = Window.partitionBy(key).orderBy(F.desc("total_bytes"), "items")
    return batches.withColumn("batch", F.row_number().over(w) - 1).select(key, "batch", "items", "total_bytes", (F.col("batch") * F.lit(stagger_s)).alias("start_delay_s"))


def chunks(messages: DataFrame, size: str, limit: int, *, keys, order) -> DataFrame:
    """Adds ``chunk``: a buffer takes messages in order and is closed once it exceeds ``limit``.

    The reset makes this sequential within a stream: one task's sorted stream, of which the
    buffer's number and fill are held. A null size counts as 0.
    """

    def fresh() -> Callable[[int], int]:
        at, held = 0, 0

        def chunk(s: int) -> int:
            nonlocal at, held
            own, held = at, held + s
            if held > limit:
                at, held = at + 1, 0
            return own

        return chunk

    return _numbered(messages.select(*keys, *order, _sized(size)), list(keys), [F.asc_nulls_last(c) for c in order], size, fresh, "chunk")


def lane_plan(count: int, *, online: bool = False, lanes: int = 4, stagger_s: float = 2.0) -> list[tuple[int, float]]:
    """(lane, start delay) for a run over ``count`` items; the online lane starts at once."""
    if online or not count:
        return [(0, 0.0)] if count else []
    return [(k, k * stagger_s) for k in range(min(lanes, count))]


def sample_places(n: int, most: int) -> list[int]:
    """Up to ``most`` of ``n`` places, evenly spread with both ends; halves to even."""
    if n <= most:
        return list(range(n))
    return [round(k * (n - 1) / (most - 1)) for k in range(most)] if most > 1 else [0]


def spread(n: Column, most: int) -> Column:
    """``sample_places`` of a number in a column, as an array."""
    whole = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (n - 1) / F.lit(float(max(1, most - 1))), 0).cast("bigint"))
    return F.when(n < 1, F.array().cast("array<bigint>")).when(n <= most, whole).otherwise(some)


def allowed_errors(total: int, share: float = 0.01) -> int:
    return max(LEAST_BUDGET, math.ceil(share * total))
