"""Percentiles with relative rank error that can be merged.

Method: relative-rank compactors.  A sketch is a stack of buffers; an item of
level h stands for 2^h items.  A full buffer keeps its lowest items untouched
and passes every second of the others up, so low ranks stay exact and the
error of a rank grows only in proportion to it.  How far up the kept part
reaches follows a counter (the number of its trailing ones), and sections
shrink as the counter grows.  For the upper tail the values are negated, so
each percentile is read from the sketch that protects its side.

Sketches are rows (one per level), so those of separate partitions, files or
days are merged by union: levels are concatenated, counters OR-ed, and full
buffers compacted.  A sketch holds O(section * log^1.5(n)) values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.staging import stage

#: Items of a section at the start; the relative standard error is about 0.13 / SECTION.
SECTION = 64
SECTIONS = 3
#: Relative rank error that ``percentiles`` stays within but for odd chances (about five standard errors).
BOUND = 0.01
#: Values that a task holds before it hands its sketches on.
HELD = 2_000_000
#: Sketches of this many tasks are merged at once.
FAN_IN = 64


class Compactors:
    """Buffers of one sketch that protects low values."""

    def __init__(self, seed: int):
        self.items: list[np.ndarray] = [np.empty(0)]
        self.counter = [0]
        self.rng = np.random.default_rng(seed)

    def shape(self, h: int) -> tuple[int, int]:
        """Sections and section size of level h: as the counter doubles in length, sections double and shrink."""
        sections, size = SECTIONS, float(SECTION)
        while self.counter[h] >= 1 << (sections - 1) and size / 2**0.5 >= 4:
            sections, size = sections * 2, size / 2**0.5
        return sections, 2 * round(size / 2)

    def add(self, h: int, values: np.ndarray, counter: int = 0) -> None:
        while len(self.items) <= h:
            self.items.append(np.empty(0))
            self.counter.append(0)
        self.items[h] = np.concatenate([self.items[h], values])
        self.counter[h] |= counter

    def squeeze(self) -> None:
        h = 0
        while h < len(self.items):
            sections, size = self.shape(h)
            room = 2 * sections * size
            if len(self.items[h]) > room:
                ones = (~self.counter[h] & (self.counter[h] + 1)).bit_length() - 1
                keep = room // 2 + max(0, sections - ones - 1) * size
                keep += (len(self.items[h]) - keep) % 2
                row = np.sort(self.items[h])
                self.items[h] = row[:keep]
                self.counter[h] += 1
                self.add(h + 1, row[keep + int(self.rng.integers(2)) :: 2])
            h += 1

    def size(self) -> int:
        return sum(map(len, self.items))


def _levels(keys: list[str], key: tuple, side: str, s: Compactors, part: int) -> Iterator[dict]:
    for h, row in enumerate(s.items):
        if len(row):
            yield dict(zip(keys, key)) | {"side": side, "level": h, "counter": s.counter[h], "items": row, "part": part}


def sketch(values: DataFrame, keys: list[str], value: str, seed: int = 7) -> DataFrame:
    """Sketch rows (``keys``, ``side``, ``level``, ``counter``, ``items``) of ``value`` per ``keys``.

    Null and NaN values don't count; null keys are a group of their own; an
    empty table gives no rows.  Keys may not have the names of the other
    columns; further columns of ``values`` are ignored.  Every task sketches what it reads, so a hot
    group is never brought together.
    """
    if clash := {"side", "level", "counter", "items", "part"} & set(keys):
        raise ValueError(f"keys {clash} are names of the sketch")
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    out = f"{head}, side string, level int, counter bigint, items array<double>, part int"
    rows = values.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, tuple[Compactors, Compactors]] = {}
        flushed = 0

        def flush() -> pd.DataFrame:
            lines = [x for k, both in held.items() for side, s in zip(("low", "high"), both) for x in _levels(keys, k, side, s, part)]
            held.clear()
            return pd.DataFrame(lines, columns=[*keys, "side", "level", "counter", "items", "part"])

        for batch in batches:
            for key, at in batch.groupby(keys, sort=False, dropna=False).indices.items() if len(batch) else ():
                key = tuple(None if x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                v = batch["_v"].to_numpy()[at]
                if key not in held:
                    held[key] = tuple(Compactors(hash((seed, part, len(held), flushed, i)) & 0x7FFFFFFF) for i in (0, 1))
                for s, x in zip(held[key], (v, -v)):
                    s.add(0, x)
                    s.squeeze()
            if sum(s.size() for both in held.values() for s in both) > HELD:
                flushed += 1
                yield flush()
        yield flush()

    return merge_sketches(rows.mapInPandas(build, out), keys, seed)


def merge_sketches(parts: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """One sketch per ``keys`` and side from the rows of many (a union of ``sketch`` results).

    Sketches are merged in a tree, ``FAN_IN`` at once and as deep as their
    number asks for, each compacted before the next is added; so no task holds
    more than one sketch and what it adds.
    """
    if "part" not in parts.columns:
        parts = parts.withColumn("part", F.pmod(F.xxhash64("items"), F.lit(FAN_IN * FAN_IN)).cast("int"))
    out, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema), parts.columns

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        key = tuple(first[k] for k in keys)
        pdf = pdf.sort_values(["part", "level"], kind="stable")
        s = Compactors(hash((seed, int(first["part"]), len(pdf))) & 0x7FFFFFFF)
        for _, one in pdf.groupby("part", sort=False):
            for h, c, x in zip(one["level"], one["counter"], one["items"]):
                s.add(int(h), np.asarray(x, dtype=float), int(c))
            s.squeeze()
        return pd.DataFrame(list(_levels(keys, key, first["side"], s, int(first["part"]) // FAN_IN)), columns=names)

    level = stage(parts, "sketches")
    numbers = level.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    while True:
        merged = level.groupBy(*keys, "side", F.expr(f"part div {FAN_IN}").alias("_g")).applyInPandas(merge, out)
        numbers = -(-numbers // FAN_IN)
        if numbers == 1:
            return merged.drop("part")
        level = stage(merged, "sketches")


def percentiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """``keys``, ``share``, ``n``, ``value``: the value of rank ceil(share * n), at least 1, by the sketch of its side.

    Shares up to one half are read from below, others from above, so rank r is
    off by at most about BOUND * min(r, n - r + 1).
    """
    items = sketches.select(*keys, "side", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")).alias("w"), F.explode("items").alias("v"))
    by = Window.partitionBy(*keys, "side")
    run = items.withColumn("n", F.sum("w").over(by)).withColumn("reach", F.sum("w").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    asked = run.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("share") * F.col("n") - 1e-9))
    asked = asked.withColumn("rank", F.when(F.col("side") == "low", rank).otherwise(F.col("n") - rank + 1))
    asked = asked.where(((F.col("side") == "low") == (F.col("share") <= 0.5)) & (F.col("reach") >= F.col("rank")))
    return asked.groupBy(*keys, "share", "n").agg(F.min("v").alias("v"), F.min("side").alias("side")).select(*keys, "share", "n", F.when(F.col("side") == "low", F.col("v")).otherwise(-F.col("v")).alias("value"))
