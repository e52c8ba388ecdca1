"""Filling containers of fixed capacity with items of varying size.

Method: bulk-synchronous best fit.  A superstep range-sorts the items that have
no container yet, from the largest, together with the open gaps, and deals both
in this order to sweeps of about ``SWEEP`` rows (more if these fill less than ``LEAST``
containers), so that every sweep gets the same spread of sizes.  The sweeps run in parallel.  Each goes through its items
by rank; an item takes its successor, the smallest gap that holds it, and puts
back what it leaves of it.  Of items that want the same gap the one first in
rank has it, the others go on to the next gap.  Where no gap is left, a
container is opened: one for every item over half a container, and otherwise no
more than the sweep's tokens fill beyond the room that it was dealt.  What finds
no place waits; gaps are updated, and the next superstep sorts and deals again,
so that gaps of one sweep meet items of others.

Items left are about one container's in a sweep, so supersteps grow with the
logarithm of the number of items.  Once a kind's rows fit into one sweep, or a
superstep leaves more than ``SLOW`` of its items, the next one opens as many
containers as it needs; at most one of a sweep's is then far from full.  All
tables stay distributed; the driver sees one row for each kind of container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.physical import range_sorted
from framelake.staging import stage, unstage

#: Container kinds in one call; each is a small parameter row. More are an error.
MOST_KINDS = 1000
#: Items and gaps of a sweep, unless these are too small to fill ``LEAST`` containers.
SWEEP = 1024
#: Containers that a sweep's items fill at least, so that its last one matters little.
LEAST = 8
#: Share of its items that a superstep may leave without opening all containers next.
SLOW = 0.5


def container_kinds(kinds: DataFrame) -> list[tuple]:
    """The usable (kind, capacity) rows of ``kinds``; an error if there are too many or a kind has two capacities."""
    rows = kinds.where("kind is not null and capacity >= 1").select("kind", F.col("capacity").cast("bigint")).distinct().limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} container kinds")
    if len({r["kind"] for r in rows}) < len(rows):
        raise ValueError("a container kind has several capacities")
    return sorted((r["kind"], r["capacity"]) for r in rows)


def best_fit(sizes: list[int], gaps: list[int], capacity: int, budget: int | None) -> tuple[list[int], list[int]]:
    """The gap of each item (-1: none) and what every gap has left in the end.

    Items come by rank, from the largest; new gaps follow the given ones.  With
    a ``budget``, items up to half the capacity open no more than so many gaps, those
    of larger items counted with them.
    """
    free = list(gaps)
    order = sorted((f << 32) | i for i, f in enumerate(free) if f > 0)
    where = []
    for s in sizes:
        at = bisect_left(order, s << 32)
        if at < len(order):
            g = order.pop(at) & 0xFFFFFFFF
        elif 2 * s > capacity or budget is None or budget > 0:
            g = len(free)
            free.append(capacity)
            if budget is not None:
                budget -= 1
        else:
            where.append(-1)
            continue
        where.append(g)
        free[g] -= s
        if free[g]:
            insort(order, (free[g] << 32) | g)
    return where, free


def _sweeps(rows: DataFrame, capacity: list[int], sweeps: list[int], first: list[int], final: list[bool]) -> DataFrame:
    """One superstep over range-sorted items (``t`` = 1) and gaps (``t`` = 0, container ``c``); staged.

    Items come back with their container ``c`` (null: none), gaps with the
    ``size`` that they have left.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"k int, t int, size bigint, c bigint, id {kinds['id']}, piece int"

    def sweep(key: tuple, table: pa.Table) -> pa.Table:
        k, number = (x.as_py() for x in key)
        t, size = table["t"].to_numpy(), table["size"].to_numpy()
        at = np.lexsort((table["_row"].to_numpy(), table["_part"].to_numpy()))
        items, old = at[t[at] == 1], at[t[at] == 0]
        sizes, gaps = size[items].tolist(), size[old].tolist()
        budget = None if final[k] else max(0, (sum(sizes) - sum(gaps)) // capacity[k])
        where, free = best_fit(sizes, gaps, capacity[k], budget)
        # the sweeps of a superstep number their new containers in turn
        name = np.concatenate([table["c"].take(pa.array(old)).to_numpy(), first[k] + number + sweeps[k] * np.arange(len(free) - len(old))]).astype(np.int64)
        where = np.array(where, dtype=np.int64)
        mine = pa.array(name[where] if len(name) else where, mask=where < 0)
        placed = table.select(["id", "piece"]).take(pa.array(items))
        open_ = np.nonzero(free)[0]
        none = lambda n, kind: pa.nulls(n, kind)
        n, m = len(items), len(open_)
        return pa.table({
            "k": pa.array(np.full(n + m, k, dtype=np.int32)),
            "t": pa.array(np.repeat(np.array([1, 0], dtype=np.int32), [n, m])),
            "size": pa.array(np.concatenate([size[items], np.array(free, dtype=np.int64)[open_]])),
            "c": pa.concat_arrays([mine, pa.array(name[open_])]),
            "id": pa.chunked_array([*placed["id"].chunks, none(m, placed["id"].type)], type=placed["id"].type),
            "piece": pa.chunked_array([*placed["piece"].chunks, none(m, pa.int32())], type=pa.int32()),
        })

    deal = F.pmod(F.col("_row") + F.col("_part"), _of_kind(sweeps))
    return stage(rows.withColumn("_sweep", deal).groupBy("k", "_sweep").applyInArrow(sweep, out), "pack-placed")


def _of_kind(values: list[int]) -> Column:
    """The value of the row's kind number ``k``."""
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("k") + 1)


def pack(items: DataFrame, kinds: DataFrame, sweep: int = SWEEP) -> DataFrame:
    """``kind``, ``container``, ``id``, ``piece``, ``tokens``: where each item goes in each kind of container.

    ``items``: ``id``, ``tokens``; ``kinds``: ``kind``, ``capacity`` (at least
    1; others are ignored; more than ``MOST_KINDS`` or two capacities of a kind
    are an error).  An item larger than the capacity is split into pieces of
    the capacity and a rest; no other is split.  Items of null or no size take
    no room in container 0.  Every row is an item of its own, also when an id
    repeats.  Containers are numbered from 0 within their kind; where several
    sweeps open some, a few numbers stay unused.
    """
    names = container_kinds(kinds)
    size = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint")
    out_kind = kinds.schema["kind"].dataType
    if not names:
        return items.select(F.lit(None).cast(out_kind).alias("kind"), F.lit(0).cast("bigint").alias("container"), "id", F.lit(0).alias("piece"), size.alias("tokens")).limit(0)
    caps = [c for _, c in names]
    rows = items.select("id", size.alias("tokens"), F.explode(F.array(*[F.lit(k) for k in range(len(names))])).alias("k")).withColumn("cap", _of_kind(caps))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0).cast("bigint"), F.expr("(tokens + cap - 1) div cap - 1")).cast("int"))))
    none = F.lit(None).cast("bigint")
    base = rows.select("k", F.lit(1).alias("t"), F.least(F.col("cap"), F.col("tokens") - F.col("piece") * F.col("cap")).alias("size"), none.alias("c"), "id", "piece")
    empty = base.where("size = 0").withColumn("c", F.lit(0).cast("bigint"))
    order = [F.col("k"), F.desc("size"), F.col("t"), F.col("c"), F.col("id"), F.col("piece")]

    todo, placed = base.where("size > 0"), [empty]
    left: dict[int, int] | None = None
    first, final = [0] * len(caps), [False] * len(caps)
    while True:
        sorted_rows = range_sorted(todo, order, "pack-order")
        n = {r["k"]: (r["items"], r["rows"], r["tokens"]) for r in sorted_rows.groupBy("k").agg(F.sum("t").alias("items"), F.count("*").alias("rows"), F.sum(F.col("t") * F.col("size")).alias("tokens")).collect()}
        sweeps = [1] * len(caps)
        for k, (now, both, tokens) in n.items():
            sweeps[k] = max(1, min(-(-both // sweep), tokens // (LEAST * caps[k])))
            final[k] = sweeps[k] == 1 or (left is not None and now > SLOW * left[k])
        done = _sweeps(sorted_rows, caps, sweeps, first, final)
        unstage(sorted_rows)
        placed.append(done.where("t = 1 and c is not null"))
        waits = F.col("c").isNull()
        state = done.groupBy("k").agg(F.count(F.when(waits, 1)).alias("waiting"), F.min(F.when(waits, F.col("size"))).alias("least"), F.max("c").alias("last")).collect()
        least = [0] * len(caps)
        for r in state:
            first[r["k"]] = max(first[r["k"]], (-1 if r["last"] is None else r["last"]) + 1)
            least[r["k"]] = r["least"] or 0
        if not sum(r["waiting"] for r in state):
            break
        left = {k: now for k, (now, _, _) in n.items()}
        # gaps too small for every waiting item stay out
        todo = done.where((waits | (F.col("t") == 0)) & (_of_kind(least) > 0) & (F.col("size") >= _of_kind(least)))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    label = F.element_at(F.array(*[F.lit(name) for name, _ in names]), F.col("k") + 1).cast(out_kind)
    return out.select(label.alias("kind"), F.col("c").alias("container"), "id", "piece", F.col("size").alias("tokens"))


def fills(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kind``, ``container``, ``items``, ``used``, ``free`` of every container of a ``pack`` result."""
    each = packed.groupBy("kind", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))
    sizes = kinds.sparkSession.createDataFrame(container_kinds(kinds), f"kind {kinds.schema['kind'].dataType.simpleString()}, capacity bigint")
    return each.join(F.broadcast(sizes), "kind").select("kind", "container", "items", "used", (F.col("capacity") - F.col("used")).alias("free"))
