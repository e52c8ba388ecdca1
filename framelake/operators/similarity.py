"""Nearest neighbours and suppression of near twins among vectors; exact.

Search takes a set of queries against all rows in blocks: rows and queries are
packed into matrices of a bounded number of bytes, every task multiplies its
blocks with each block of queries and keeps the k best for each query, and these
partial lists are merged.  Queries are broadcast ``BROADCAST_BYTES`` at a time, in
as many passes over the rows as that takes, so rows are never copied or
shuffled again.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.physical import part_offsets, range_sorted
from framelake.staging import stage

#: Bytes of a matrix block (of 8-byte numbers) and its most rows.
BLOCK_BYTES, BLOCK = 4 << 20, 2048
#: Bytes of query blocks that are broadcast at once.
BROADCAST_BYTES = 64 << 20
#: Windows in a stretch of time that one task searches for near twins.
STRETCH = 50
#: Rows that ``suppress`` compares at once.
SLICE = 256
#: Near twins that a task holds before it sends them on.
PAIRS = 100_000


def _block_rows(rows: DataFrame) -> int:
    """Rows of a block, by the length of the vectors."""
    one = rows.select(F.size("v").alias("n")).first()
    return max(16, min(BLOCK, BLOCK_BYTES // (8 * max(1, one["n"] if one else 1))))


def _blocks(rows: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (``id``, ``v``) of equal ``keys`` in blocks numbered from 0: a hash of the id spreads them evenly."""
    size = _block_rows(rows)
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_n")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumn("_one", F.lit(1))
    on = [F.col("_1") == F.col("_one"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    rows = rows.withColumn("_1", F.lit(1)).join(n, on).withColumn(f"{prefix}_b", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), "_n")).cast("int"))
    return rows.groupBy(*keys, f"{prefix}_b").agg(F.collect_list(F.struct("id", "v")).alias(prefix))


def _matrix(block) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x["id"] for x in block]), np.stack([np.asarray(x["v"], dtype=float) for x in block])


def top_k(queries: DataFrame, rows: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """``qid``, ``id``, ``sim``, ``rank`` (1..k): the k rows of greatest dot product for each query, ties by id.

    Both have bigint ``id`` and a vector ``v``; null vectors and ids are left
    out.  Equal similarities to twelve digits are ties.
    """
    q = stage(queries.where("v is not null and id is not null").select("id", "v"), "queries")
    r = stage(rows.where("v is not null and id is not null").select("id", "v"), "rows")
    qb, rb = stage(_blocks(q, "q"), "query-blocks"), stage(_blocks(r, "r"), "row-blocks")

    def multiply(batches):
        for batch in batches:
            for qs, rs in zip(batch["q"], batch["r"]):
                (qi, qv), (ri, rv) = _matrix(qs), _matrix(rs)
                sim = qv @ rv.T
                order = np.lexsort((np.broadcast_to(ri, sim.shape), -np.round(sim, 12)), axis=1)[:, : k + drop_self]
                at = np.arange(len(qi))[:, None]
                yield pd.DataFrame({"qid": np.repeat(qi, order.shape[1]), "id": ri[order].ravel(), "sim": sim[at, order].ravel()})

    most = (qb.agg(F.max("q_b")).first()[0] or 0) + 1
    step = max(1, BROADCAST_BYTES // BLOCK_BYTES)
    partial = None
    for first in range(0, most, step):
        some = qb.where((F.col("q_b") >= first) & (F.col("q_b") < first + step)).select("q").withColumn("_key", F.lit(1))
        met = rb.select("r").withColumn("_key", F.lit(1)).join(F.broadcast(some), "_key").select("q", "r").mapInPandas(multiply, "qid bigint, id bigint, sim double")
        partial = met if partial is None else partial.unionByName(met)
    if drop_self:
        partial = partial.where("qid != id")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 12)), "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``qid``, ``label``, ``weight``: the label with the greatest sum of similarities among a query's neighbours, ties by label."""
    j = neighbours.join(labels, "id").groupBy("qid", "label").agg(F.round(F.sum("sim"), 9).alias("weight"))
    return j.groupBy("qid").agg(F.min_by(F.struct("label", "weight"), F.struct(-F.col("weight"), F.col("label"))).alias("s")).select("qid", "s.label", "s.weight")


def band_pairs(rows: DataFrame, at: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (columns with suffixes ``_a``, ``_b``) of rows of equal ``keys`` with 0 < at_b - at_a <= width.

    A banded range join: each row is in the bucket of its position and asked for
    in its own and the next, so the join is by equality and each pair is found
    once.  Null positions are in no pair.
    """
    rows = rows.where(F.col(at).isNotNull())
    bucket = F.floor(F.col(at) / width)
    a = rows.select([F.col(c).alias(f"{c}_a") for c in rows.columns]).withColumn("_b", F.explode(F.array(F.floor(F.col(f"{at}_a") / width), F.floor(F.col(f"{at}_a") / width) + 1)))
    b = rows.withColumn("_b", bucket).select("_b", *[F.col(c).alias(f"{c}_b") for c in rows.columns])
    cond = F.col(f"{at}_b") - F.col(f"{at}_a")
    on = [a["_b"] == b["_b"], *[F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys], cond > 0, cond <= width]
    return a.join(b, on).drop("_b")


def suppress(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cutoff: float, cap: int | None = None, window: tuple[str, float] | None = None) -> DataFrame:
    """Greedy suppression within groups: a row is kept if it is less than ``cutoff`` similar to all kept before it.

    ``rows`` has ``id`` and ``v``; the order is ascending.  With ``window``
    (column, width) only kept rows at most that far apart count; with ``cap``
    no more than that many are kept in a group.  The decision is sequential by
    definition, so a group is worked off in one task; rows are read in sorted
    order, compared by matrix products, and only kept vectors are held (with
    ``window`` those in reach).
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    cols = [*keys, "id"]
    at, width = window or (None, None)

    def run(batches):
        now, n, first, have, held, where = None, 0, 0, 0, np.empty((0, 0)), np.empty(0)
        for b in batches:
            if not len(b):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in b["v"]])
            pos = b[at].to_numpy().astype(float) if at else np.zeros(len(b))
            keys_of = list(zip(*[b[k] for k in keys])) if keys else [()] * len(b)
            starts = [i for i in range(len(b)) if i == 0 or keys_of[i] != keys_of[i - 1]]
            out = []
            for lo, hi in zip(starts, [*starts[1:], len(b)]):
                if keys_of[lo] != now:
                    now, n, first, have = keys_of[lo], 0, 0, 0
                if held.shape[1] != x.shape[1]:
                    held, where = np.empty((1024, x.shape[1])), np.empty(1024)
                # rows against all kept before, SLICE at once; rows of a slice among themselves
                for i in range(lo, hi, SLICE):
                    part, p = x[i : min(hi, i + SLICE)], pos[i : min(hi, i + SLICE)]
                    if at:
                        first += int(np.searchsorted(where[first:have], p[0] - width, side="left"))
                    old, when = held[first:have], where[first:have]
                    near = part @ old.T >= cutoff
                    if at:
                        near &= p[:, None] - when[None, :] <= width
                    blocked = near.any(axis=1)
                    among = part @ part.T >= cutoff
                    if at:
                        among &= p[:, None] - p[None, :] <= width
                    new: list[int] = []
                    for j in np.flatnonzero(~blocked):
                        if cap is not None and n >= cap:
                            break
                        if not among[j, new].any():
                            new.append(int(j))
                            n += 1
                    if have + len(new) > len(held):
                        size = max(2 * (have - first + len(new)), 1024)
                        bigger, times = np.empty((size, held.shape[1])), np.empty(size)
                        bigger[: have - first], times[: have - first] = held[first:have], where[first:have]
                        held, where, have, first = bigger, times, have - first, 0
                    held[have : have + len(new)], where[have : have + len(new)] = part[new], p[new]
                    have += len(new)
                    out += [i + j for j in new]
            yield b.iloc[out][cols]

    by = [*keys, *([at] if at and at not in order else []), *order]
    ready = rows.where("v is not null").repartition(*keys).sortWithinPartitions(*by)
    return ready.select(*dict.fromkeys([*cols, "v", *([at] if at else [])])).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols))


def most_similar(rows: DataFrame, others: DataFrame, keys: Sequence[str], earlier: bool = False) -> DataFrame:
    """``id``, ``other``, ``sim``: the row of ``others`` of equal ``keys`` that is most similar, ties by id; with ``earlier`` only rows of a lower id, else any other.

    Blocks of equal keys meet, so a hot key is shared by as many tasks as it has
    pairs of blocks; each gives one row for each of its queries.  Null keys are
    in no group; null vectors and ids are left out.
    """
    usable = " and ".join(["id is not null", "v is not null", *[f"`{k}` is not null" for k in keys]])
    a, b = (stage(df.where(usable).select(*keys, "id", "v"), "vectors") for df in (rows, others))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _blocks(a, "q", keys).join(_blocks(b, "r", keys), list(keys)).select(*keys, "q", "r", "q_b", "r_b")

    def best(batches):
        for batch in batches:
            for qs, rs in zip(batch["q"], batch["r"]):
                (qi, qv), (ri, rv) = _matrix(qs), _matrix(rs)
                order = np.argsort(ri, kind="stable")
                ri = ri[order]
                sim = np.round(qv @ rv[order].T, 9)
                sim[(ri[None, :] >= qi[:, None]) if earlier else (ri[None, :] == qi[:, None])] = -np.inf
                at = np.argmax(sim, axis=1)  # the first, so the lowest id
                top = sim[np.arange(len(qi)), at]
                ok = top > -np.inf
                yield pd.DataFrame({"id": qi[ok], "other": ri[at[ok]], "sim": top[ok]})

    found = pairs.repartition(parts, "q_b", "r_b", *keys).select("q", "r").mapInPandas(best, "id bigint, other bigint, sim double")
    return found.groupBy("id").agg(F.max_by(F.struct("other", "sim"), F.struct("sim", -F.col("other"))).alias("s")).select("id", "s.other", "s.sim")


def _near_in_time(rows: DataFrame, width: float, cutoff: float, kinds: dict[str, str]) -> DataFrame:
    """Pairs ``a``, ``b`` of rows of equal ``_k``, ``b`` later by (t, id) and at most ``width``, whose similarity is at least ``cutoff``.

    Time is cut into stretches; a row stands in its own as either of a pair and
    in the one before, if it lies near its start, as the later only, so no pair
    is lost at an edge or found twice.  A task holds one window of rows.
    """
    size = (width or 1) * STRETCH
    own = F.floor(F.col("t") / size)
    reach = F.sequence(F.floor((F.col("t") - 2 * width) / size), own)
    ready = rows.withColumn("_own", own).withColumn("_at", F.explode(reach)).withColumn("_first", F.col("_at") == F.col("_own")).drop("_own")

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            df = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if df is None or not len(df):
                continue
            n, k, at, t, first = len(df), df["_k"].to_numpy(), df["_at"].to_numpy(), df["t"].to_numpy(), df["_first"].to_numpy()
            x = np.stack([np.asarray(v, dtype=float) for v in df["v"]])
            change = np.flatnonzero((k[1:] != k[:-1]) | (at[1:] != at[:-1])) + 1
            ends = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
            left, right, found, hi, rest = [], [], 0, 0, None
            for i in range(n):
                hi = max(hi, i + 1)
                while hi < ends[i] and t[hi] - t[i] <= width:
                    hi += 1
                if hi == n and batch is not None:  # later rows of its window may follow
                    rest = df.iloc[i:]
                    break
                if first[i]:
                    near = i + 1 + np.flatnonzero(x[i + 1 : hi] @ x[i] >= cutoff)
                    left.append(np.full(len(near), i))
                    right.append(near)
                    found += len(near)
                if found > PAIRS:
                    yield table(df, left, right)
                    left, right, found = [], [], 0
            if found:
                yield table(df, left, right)

    def table(df, left, right):
        a, b = df.iloc[np.concatenate(left)], df.iloc[np.concatenate(right)]
        return pd.DataFrame({"_k": a["_k"].to_numpy()} | {f"{c}_{side}": x[c].to_numpy() for side, x in (("a", a), ("b", b)) for c in ("t", "id", "s", "g")})

    ready = ready.repartition("_k", "_at").sortWithinPartitions("_k", "_at", "t", "id").select("_k", "_at", "_first", "t", "id", "s", "g", "v")
    return ready.mapInPandas(run, "_k string, " + ", ".join(f"{c}_{side} {kinds[c]}" for side in "ab" for c in ("t", "id", "s", "g")))


def _stretches(pairs: DataFrame) -> DataFrame:
    """``_k``, ``_no`` and the pairs: pairs of different ``_no`` share no row, since no pair reaches over from one to the next.

    Pairs are range-sorted by their earlier row; a new number begins where that
    row lies beyond all later rows so far, which each part learns from the parts before it.
    """
    data = range_sorted(pairs, [F.col(c) for c in ("_k", "t_a", "id_a", "t_b", "id_b")], "near")
    start, end = (F.struct(F.col(f"t_{x}").alias("t"), F.col(f"id_{x}").alias("id")) for x in "ab")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ends = data.groupBy("_part", "_k").agg(F.max(end).alias("_end"))
    ends = ends.select("_part", "_k", F.max("_end").over(before.partitionBy("_k").orderBy("_part")).alias("_far"))
    own = Window.partitionBy("_part", "_k").orderBy("_row")
    j = data.join(ends, ["_part", "_k"]).withColumn("_far", F.greatest("_far", F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))))
    j = j.withColumn("_new", F.coalesce((start > F.col("_far")).cast("int"), F.lit(1))).drop("_far")
    j = j.withColumn("_no", F.sum("_new").over(own))
    return j.join(part_offsets(j, ["_k"], F.col("_new")), ["_part", "_k"]).withColumn("_no", F.col("_no") + F.col("_before")).drop("_new", "_before", "_part", "_row")


def demote_near(rows: DataFrame, keys: Sequence[str], time: str, width: float, cutoff: float, score: str, guarded: str) -> DataFrame:
    """``id``, ``by``: rows demoted because a near twin in time is better.

    Within ``keys`` (none: the whole table) rows are taken by (time, id); each
    that is still standing is compared with the standing ones at most ``width``
    later whose similarity is at least ``cutoff``: the lower score is demoted
    (the later one at equality), and a row that loses is not compared further.
    A row with ``guarded`` true is never demoted.  Null times are left out.

    Similar pairs are found in parallel; only their order matters to who wins,
    so each stretch of pairs that no pair leads out of is worked off by itself.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kinds = {"t": kinds[time], "id": kinds["id"], "s": kinds[score], "g": "boolean"}

    def settle(batches):
        now, gone = None, {}
        for p in batches:
            out = []
            for key, no, ta, a, sa, ga, tb, b, sb, gb in p.itertuples(index=False, name=None):
                if (key, no) != now:
                    now, gone = (key, no), {}
                if a in gone or b in gone:
                    continue
                lost, won, t, held = (a, b, ta, ga) if sb > sa else (b, a, tb, gb)
                if not held:
                    gone[lost] = t
                    out.append((lost, won))
            if len(p):
                gone = {i: t for i, t in gone.items() if t >= ta}  # earlier rows are in no later pair
            yield pd.DataFrame(out, columns=["id", "by"])

    ready = rows.where(F.col(time).isNotNull() & F.col("v").isNotNull() & F.col(score).isNotNull())
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    ready = ready.select(key.alias("_k"), "id", F.col(time).alias("t"), F.col(score).alias("s"), F.coalesce(guarded, F.lit(False)).alias("g"), "v")
    cols = ["_k", "_no", "t_a", "id_a", "s_a", "g_a", "t_b", "id_b", "s_b", "g_b"]
    pairs = _stretches(_near_in_time(ready, width, cutoff, kinds)).select(*cols)
    return pairs.repartition("_k", "_no").sortWithinPartitions("_k", "_no", "t_a", "id_a", "t_b", "id_b").mapInPandas(settle, f"id {kinds['id']}, by {kinds['id']}")
