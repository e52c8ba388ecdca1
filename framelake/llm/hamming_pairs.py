"""Near-duplicate records: pairs of 64-bit hashes that differ in few bits, and groups of them.

Method: Bayesian candidate pruning.  A hash is read as the set of its
(position, bit) features.  Under a permutation that orders positions first, the
MinHash of such a set is the bit at the first position, so successive
positions of one permutation give successive MinHash values, drawn without
replacement: of ``d`` differing bits, ``m`` differ among the first ``k`` values
with hypergeometric probability.

Candidates come from banding: the bits are split into ``max_distance + 2``
blocks, and two hashes meet in every band (pair of blocks) in which they agree;
two close hashes do so in one band at least.  The band's values are the first
that were compared, all equal; further ones are drawn block by block, in an
order of the band's own.  After each block a pair is dropped once the posterior
probability that it is close (prior: every ``d`` equally likely) falls below
``tolerance``.  What is left is verified exactly.

A single comparison errs for some close pairs.  But most of these agree in
several bands, which draw in different orders, and a pair is found if any of
them keeps it.  ``lost`` counts all ways in which the differing bits of a close
pair can lie in the blocks and says which are pruned in every band; the default
tolerance is the largest of ``TOLERANCES`` for which there is none, so pruning
loses no pair at all.  A larger tolerance prunes more and may lose pairs, zero
prunes only what cannot be close.

Work is done on distinct hashes; copies are joined back at the end.
"""

from __future__ import annotations

import random
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.pairing import pairs_within
from framelake.physical import broadcast_if_small
from framelake.staging import stage

BITS = 64
#: Distinct hashes in one band beyond which the band is split by the bits it doesn't cover, up to ``LEVELS`` times.
BAND_LIMIT = 4096
LEVELS = 3
#: Tolerances that are tried for the default.
TOLERANCES = (0.2, 0.1, 0.05, 0.02, 0.01, 1e-3, 1e-4, 1e-6)
#: Largest distance for which all patterns of differing bits are counted; beyond it the default tolerance is zero.
COUNTED = 8


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def posterior(k: int, m: int, max_distance: int) -> float:
    """P(distance <= max_distance | m of k compared values differ), every distance 0..64 equally likely before."""
    like = [comb(d, m) * comb(BITS - d, k - m) for d in range(BITS + 1)]
    return sum(like[: max_distance + 1]) / sum(like)


def allowed(k: int, max_distance: int, tolerance: float) -> int:
    """Most differing values among ``k`` at which a pair is still kept; -1 if none."""
    return max([m for m in range(k + 1) if posterior(k, m, max_distance) >= max(tolerance, 1e-300)], default=-1)


def _patterns(most: int, blocks: int) -> np.ndarray:
    """All ways to have 1..most differing bits in the blocks: one row of numbers a pattern."""
    rows = np.zeros((1, 0), dtype=np.int8)
    for _ in range(blocks):
        rows = np.concatenate([np.column_stack([rows[rows.sum(axis=1) <= most - d], np.full((rows.sum(axis=1) <= most - d).sum(), d, dtype=np.int8)]) for d in range(most + 1)])
    return rows[rows.sum(axis=1) > 0]


class Layout:
    """Where bits, blocks, bands and values are.

    Hashes are handled with their bits permuted (distances stay the same), so
    that a block is a run of bits.  A band is a pair of blocks; its key holds
    the band and both blocks.  It draws its values from the block that follows
    its second one, around in a circle.
    """

    def __init__(self, max_distance: int, seed: int, tolerance: float | None = None):
        self.most = max_distance
        self.order = list(range(BITS))
        random.Random(seed).shuffle(self.order)
        n = max_distance + 2
        self.spans = [(i * BITS // n, (i + 1) * BITS // n) for i in range(n)]
        self.width = max(b - a for a, b in self.spans)
        self.bands = list(combinations(range(n), 2))
        self.masks = [signed(sum(1 << p for p in range(a, b))) for a, b in self.spans]
        self.draws = [[t % n for t in range(j + 1, j + n) if t % n not in (i, j)] for i, j in self.bands]
        if tolerance is None:
            tolerance = next((t for t in TOLERANCES if not len(self.lost(t))), 0.0) if max_distance <= COUNTED else 0.0
        self.tolerance = tolerance
        self.most_after = self.limits(tolerance)

    def limits(self, tolerance: float) -> list[list[int]]:
        """Per band, the differing values at which a pair is still kept after each block drawn."""
        size = [b - a for a, b in self.spans]
        out = []
        for (i, j), draw in zip(self.bands, self.draws):
            seen = size[i] + size[j] + np.cumsum([size[t] for t in draw])
            out.append([allowed(int(k), self.most, tolerance) for k in seen])
        return out

    def lost(self, tolerance: float) -> np.ndarray:
        """The patterns of differing bits (numbers in the blocks) that every band prunes or misses."""
        rows = _patterns(self.most, len(self.spans))
        found = np.zeros(len(rows), dtype=bool)
        for band, draw, most in zip(self.bands, self.draws, self.limits(tolerance)):
            found |= (rows[:, band] == 0).all(axis=1) & (np.cumsum(rows[:, draw], axis=1) <= np.array(most)).all(axis=1)
        return rows[~found]

    def parts(self, level: int) -> list[list[int]]:
        """Per path (band, then the part taken at each earlier level), the masks of the parts that the bits it leaves are cut into.

        Close hashes agree in one part at least.
        """
        n = self.most + 1
        if not level:
            left = [[p for t, (a, b) in enumerate(self.spans) if t not in band for p in range(a, b)] for band in self.bands]
        else:
            left = [[p for p in rest if not mask >> p & 1] for rest, masks in zip(self._left, self._masks) for mask in masks]
        self._left = left
        self._masks = [[sum(1 << p for p in r[s * len(r) // n : (s + 1) * len(r) // n]) for s in range(n)] for r in left]
        return [[signed(m) for m in masks] for masks in self._masks]

    def permuted(self, h: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for k, p in enumerate(self.order):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(h, p).bitwiseAND(F.lit(1).cast("bigint")), k))
        return out

    def restored(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for k, p in enumerate(self.order):
            out |= ((x >> np.int64(k)) & np.int64(1)) << np.int64(p)
        return out

    def key(self, h: Column, n: int) -> Column:
        i, j = (F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) for a, b in (self.spans[t] for t in self.bands[n]))
        return F.lit(n << 2 * self.width).cast("bigint").bitwiseOR(F.shiftleft(i, self.width)).bitwiseOR(j)


@lru_cache(maxsize=16)
def _layout(max_distance: int, seed: int, tolerance: float | None) -> Layout:
    return Layout(max_distance, seed, tolerance)


#: What ``_band_pairs`` gives: pairs, or how many pairs each block of values drops.
_PAIRS, _COUNTS = "ha bigint, hb bigint", "drawn int, compared bigint, kept bigint"


def _band_pairs(rows: DataFrame, layout: Layout, splits: list[list[list[int]]], out: str = _PAIRS) -> DataFrame:
    """Close pairs within the groups of ``rows`` (``key``, after splits also ``path`` and ``bits``, ``h``), each emitted by one group only.

    Rows are brought together by group and sorted; a task then compares each
    row with the one 1, 2, 3, ... places further in its group, for all rows at
    once, and holds one group at a time.
    """
    keys = ["key", "path", "bits"] if splits else ["key"]
    n_parts = layout.most + 1
    part_masks = [np.array(level, dtype=np.int64) for level in splits]
    band_masks = np.array([layout.masks[i] | layout.masks[j] for i, j in layout.bands], dtype=np.int64)
    drawn_masks = np.bitwise_or.accumulate(np.array([[layout.masks[t] for t in draw] for draw in layout.draws], dtype=np.int64), axis=1)
    most_after = np.array(layout.most_after)
    shift, max_distance = np.int64(2 * layout.width), layout.most
    blocks = drawn_masks.shape[1]
    counting = out == _COUNTS

    def ones(x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x.view(np.uint64))  # of signed numbers it would take the absolute value

    def owned(x: np.ndarray, band: np.ndarray, path: np.ndarray | None) -> np.ndarray:
        # the first band in which the pair meets and is not pruned has it
        keeps = (x[:, None] & band_masks) == 0
        for t in range(blocks):
            keeps &= ones(x[:, None] & drawn_masks[:, t]) <= most_after[:, t]
        ok = np.argmax(keeps, axis=1) == band
        for level, masks in enumerate(part_masks):  # and in it, the first part at every level
            at = path // n_parts ** (len(part_masks) - level)
            part = path // n_parts ** (len(part_masks) - level - 1) % n_parts
            ok &= np.argmax((x[:, None] & masks[at]) == 0, axis=1) == part
        return ok

    def compare(cols: list[np.ndarray]) -> pa.RecordBatch:
        h = cols[-1]
        n = len(h)
        new = np.zeros(n, dtype=bool)
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        ends = np.append(np.nonzero(new)[0], n) - 1
        last = ends[np.cumsum(new)]
        band = cols[0] >> shift
        at, step, found = np.nonzero(last > np.arange(n))[0], 1, []
        compared, kept = np.zeros(blocks, dtype=np.int64), np.zeros(blocks, dtype=np.int64)
        while len(at):
            x, live = h[at] ^ h[at + step], at
            for t in range(blocks):
                b = band[live]
                keep = ones(x & drawn_masks[b, t]) <= most_after[b, t]
                compared[t] += len(x)
                x, live = x[keep], live[keep]
                kept[t] += len(x)
            keep = (ones(x) <= max_distance) & (x != 0)
            x, live = x[keep], live[keep]
            if len(live) and not counting:
                live = live[owned(x, band[live], cols[1][live] if part_masks else None)]
                found.append(np.stack([h[live], h[live + step]]))
            step += 1
            at = at[at + step <= last[at]]
        if counting:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1, blocks + 1, dtype=np.int32)), pa.array(compared), pa.array(kept)], names=["drawn", "compared", "kept"])
        both = layout.restored(np.concatenate(found, axis=1)) if found else np.empty((2, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(*both)), pa.array(np.maximum(*both))], names=["ha", "hb"])

    def scan(batches):
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not b.num_rows:
                continue
            changes = np.zeros(b.num_rows, dtype=bool)
            for c in cols[:-1]:
                changes[1:] |= c[1:] != c[:-1]
            changes[0] = bool(held) and any(x[0] != y[-1] for x, y in zip(cols[:-1], held[-1][:-1]))
            cuts = np.nonzero(changes)[0]
            if len(cuts):
                cut = cuts[-1]
                held.append([c[:cut] for c in cols])
                yield compare([np.concatenate(x) for x in zip(*held)])
                held = []
                cols = [c[cut:] for c in cols]
            held.append(cols)
        if held:
            yield compare([np.concatenate(x) for x in zip(*held)])

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "h").mapInArrow(scan, out)


def _compared(hashes: DataFrame, layout: Layout, band_limit: int, out: str) -> DataFrame:
    """``_band_pairs`` of all bands; what holds more than ``band_limit`` hashes is split by further bits, and again."""
    h = F.col("h")
    distinct = hashes.where("h is not null").select("h").distinct()
    rows = distinct.select(layout.permuted(h).alias("h")).select(F.explode(F.array(*[layout.key(h, n) for n in range(len(layout.bands))])).alias("key"), "h")
    keys, splits, done = ["key"], [], None
    while True:
        hot = None
        if len(splits) < LEVELS:
            hot = stage(rows.groupBy(*keys).count().where(F.col("count") > band_limit).select(*keys), "hot-bands")
            if hot.isEmpty():
                hot = None
        marked = broadcast_if_small(hot) if hot is not None else None
        here = _band_pairs(rows if hot is None else rows.join(marked, keys, "left_anti"), layout, splits, out)
        done = here if done is None else done.unionByName(here)
        if hot is None:
            return done
        parts = layout.parts(len(splits))
        masks = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in path]) for path in parts])
        path = F.shiftright("key", 2 * layout.width).cast("int") if not splits else F.col("path")
        taken = F.lit(0).cast("bigint") if not splits else F.col("bits")
        hot_rows = rows.join(marked, keys, "left_semi").select("key", path.alias("_path"), taken.alias("_bits"), "h")
        cut = hot_rows.select("key", "_path", "_bits", "h", F.posexplode(F.element_at(masks, F.col("_path") + 1)).alias("_part", "_mask"))
        # a path says which bits are in ``bits``
        rows = cut.select("key", (F.col("_path") * (layout.most + 1) + F.col("_part")).cast("int").alias("path"), F.col("_bits").bitwiseOR(h.bitwiseAND(F.col("_mask"))).alias("bits"), "h")
        keys = ["key", "path", "bits"]
        splits = [*splits, parts]


def close_hashes(hashes: DataFrame, max_distance: int = 6, tolerance: float | None = None, band_limit: int = BAND_LIMIT, seed: int = 11) -> DataFrame:
    """Pairs (``ha``, ``hb``; ha < hb) of distinct hashes that differ in 1..max_distance bits.

    ``hashes`` has a bigint column ``h``.  Nulls are ignored, repeats count
    once, an empty table gives an empty result.  ``tolerance`` None: the largest
    one that loses nothing.
    """
    if not 0 <= max_distance <= 20:
        raise ValueError("max_distance must be in 0..20")
    if max_distance == 0:
        return hashes.select(F.col("h").alias("ha"), F.col("h").alias("hb")).where(F.lit(False))
    return _compared(hashes, _layout(max_distance, seed, tolerance), band_limit, _PAIRS)


def pruning(hashes: DataFrame, max_distance: int = 6, tolerance: float | None = None, band_limit: int = BAND_LIMIT, seed: int = 11) -> DataFrame:
    """``drawn`` (blocks of values), ``compared``, ``kept``: the comparisons that each step of the pruning sees and keeps, over all bands."""
    each = _compared(hashes, _layout(max_distance, seed, tolerance), band_limit, _COUNTS)
    return each.groupBy("drawn").agg(F.sum("compared").alias("compared"), F.sum("kept").alias("kept"))


def close_records(records: DataFrame, max_distance: int = 6, **how) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of records whose hashes differ in at most ``max_distance`` bits.

    ``records`` has ``id`` and bigint ``h``; further columns are ignored.  Rows
    with a null id or hash are in no pair; repeated rows count once; an id with
    several hashes is close to another if any of them is.
    """
    members = stage(records.where("id is not null and h is not null").select("id", "h").distinct(), "hash-members")
    pairs = close_hashes(members, max_distance, **how)
    a, b = members.select(F.col("id").alias("ia"), F.col("h").alias("ha")), members.select(F.col("id").alias("ib"), F.col("h").alias("hb"))
    other = pairs.join(a, "ha").join(b, "hb").where("ia != ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    copies = members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return other.unionByName(pairs_within(members.join(copies, "h"), "h")).distinct()


def close_groups(records: DataFrame, max_distance: int = 6, **how) -> DataFrame:
    """One row per record that has a close one: ``id``, ``group_id`` (lowest id of its component), ``group_size``.

    Links are found between distinct hashes; copies of a hash share its
    component and are never expanded into pairs.
    """
    from framelake.llm.components import connected_components

    members = stage(records.where("id is not null and h is not null").select("id", "h").distinct(), "hash-members")
    links = close_hashes(members, max_distance, **how).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    # an id with several hashes links them
    lowest = members.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a < z").select("id", "a")
    links = links.unionByName(members.join(lowest, "id").where("h != a").select("a", F.col("h").alias("b")))
    comp = connected_components(links)
    of = members.join(comp.select(F.col("node").alias("h"), "component"), "h", "left").select("id", F.coalesce("component", "h").alias("component")).distinct()
    named = of.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return of.join(named, "component").select("id", "group_id", "group_size")
