"""Long exact spans shared between records.

Method: paragraph MinHash banding.  The MinHash of a stretch of ``span``
characters is the least hash among its shingles of ``shingle`` characters; the
shingles that are the least of some stretch are a text's anchors, about
2 / (span - shingle + 2) of its characters.  An anchor's paragraph is the anchor
with ``span - shingle`` characters at either side (less at the ends of the
text), so it holds every stretch whose MinHash the anchor is.  Two paragraphs
with a common stretch have the same anchor and agree in one of two bands: the
anchor with half a side to its left, or with half a side to its right.  So the
bands are tuned to a recall of 1 at the least work: they tell apart what shares
the anchor and little else.  Colliding paragraphs are joined; verified
paragraphs form classes and sets, and documents are clustered by components.

Verification is exact and needs no pairs.  Paragraphs with the same fingerprint
(of all characters and the anchor's place) are a class: their Jaccard similarity
is one.  Where several classes of an anchor meet in a band, one paragraph of each is
cut into its stretches, and classes meet in the stretches that they have in common (edit
distance zero over ``span`` characters).

The texts are read twice for their anchors, of which only those that collide are
kept, and are looked up a third time for the classes that differ; what is
shuffled are anchors.  Groups are counted by aggregations that combine before
the shuffle and joined back, so a passage in a third of all documents is split
like any skewed key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.pairing import pairs_within
from framelake.physical import broadcast_if_light
from framelake.staging import stage

SPAN = 200
#: Share of the span that a shingle takes: shorter ones make fewer anchors, longer ones collide less by chance.
SHINGLE_SHARE = 0.6
#: Characters hashed at once; bounds a worker's memory. A longer text is a batch of its own.
BATCH_CHARS = 1_000_000
#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Public-domain 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a text, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power = np.full(n + 1, BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        self.back = np.full(n + 1, INVERSE, dtype=np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.back[:n])

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.back[low])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of x[i : i + width] for every i, by doubling; shorter at the end."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, the start of each, and the end of the text that each character is in."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(lengths)
    return codes, ends - lengths, np.repeat(ends, lengths)


def _batches(texts: list[str]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _fingerprints(roll: Rolling, at: np.ndarray, before: np.ndarray, after: np.ndarray, shingle: int) -> np.ndarray:
    """Of the paragraphs around the anchors ``at``."""
    place = before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
    return _mix(roll.between(at - before, at + shingle + after) ^ place).view(np.int64)


def anchors(texts: list[str], span: int, shingle: int) -> dict[str, np.ndarray]:
    """Of every anchor: ``doc`` (text number), ``at``, hash ``h``, and of its paragraph the fingerprint ``f``, what it has ``before`` and ``after`` the anchor,
    and the bands ``bl`` and ``br``: fingerprints of the anchor with half a side, 0 where the text ends before."""
    codes, begins, end = _joined(texts)
    n = len(codes)
    if n < span:
        return dict.fromkeys(("doc", "at", "h", "f", "bl", "br", "before", "after"), np.empty(0, dtype=np.int64))
    side = span - shingle
    roll = Rolling(codes)
    h = roll.windows(shingle)
    least = _slide(h, side + 1, np.minimum)  # of the stretch that starts here
    stretches = n - span + 1
    whole = np.arange(stretches) + span <= end[:stretches]
    # a shingle is an anchor if it is the least of one of the whole stretches that start up to ``side`` before it
    claimed = np.concatenate([np.zeros(side, dtype=np.uint64), np.where(whole, least[:stretches], 0), np.zeros(side, dtype=np.uint64)])
    spot = np.nonzero(_slide(claimed, side + 1, np.maximum) == h)[0]
    spot = spot[h[spot] > 0]
    doc = np.searchsorted(begins, spot, side="right") - 1
    at = spot - begins[doc]
    before, after = np.minimum(at, side), np.minimum(end[spot] - spot - shingle, side)
    left, right = (side + 1) // 2, side + 1 - (side + 1) // 2
    bl = np.where(before >= left, roll.between(np.maximum(spot - left, 0), spot + shingle), 0).astype(np.uint64)
    br = np.where(after >= right, roll.between(spot, np.minimum(spot + shingle + right, n)), 0).astype(np.uint64)
    return {"doc": doc, "at": at, "h": h[spot].view(np.int64), "bl": bl.view(np.int64), "br": br.view(np.int64), "f": _fingerprints(roll, spot, before, after, shingle), "before": before, "after": after}


def _text_rows(docs: DataFrame, span: int) -> DataFrame:
    return docs.where(F.col("id").isNotNull() & (F.char_length("text") >= span)).select("id", "text")


_HASHES = ("h", "f", "bl", "br")


def _anchors(docs: DataFrame, span: int, shingle: int, columns: list[str]) -> DataFrame:
    """``id`` and the named columns of every anchor."""
    kind = docs.schema["id"].dataType.simpleString()
    out = ", ".join([f"id {kind}", *[f"{c} {'bigint' if c in _HASHES else 'int'}" for c in columns]])

    def find(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            for i, j in _batches(text):
                a = anchors(text[i:j], span, shingle)
                cols = [pa.array(a[c] if c in _HASHES else a[c].astype(np.int32)) for c in columns]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(a["doc"])), *cols], names=["id", *columns])

    return _text_rows(docs, span).mapInArrow(find, out)


def colliding(docs: DataFrame, span: int = SPAN, shingle: int | None = None) -> DataFrame:
    """``id``, ``h``, ``f``, ``bl``, ``br``, ``at``, ``before``, ``after`` of all anchors whose hash occurs in more than one document; staged."""
    shingle = shingle or max(1, round(span * SHINGLE_SHARE))
    shared = _anchors(docs, span, shingle, ["h"]).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    return stage(_anchors(docs, span, shingle, ["h", "f", "bl", "br", "at", "before", "after"]).join(stage(shared, "colliding"), "h", "left_semi"), "paragraphs")


def _stretches(docs: DataFrame, found: DataFrame, span: int, shingle: int) -> DataFrame:
    """``f``, ``off``, ``x``, ``c``: the stretches (at ``off`` from the anchor) of a class that others of its anchor's classes have too; (x, c) names the set of these classes.

    A stretch belongs to the anchor that is its MinHash, so each is looked at once.
    """
    classes = stage(found.groupBy("f", "h", "bl", "br").agg(F.min(F.struct("id", "at", "before", "after")).alias("one")), "classes")
    # classes with a stretch in common agree in a band
    bands = classes.select("h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("bl").alias("b")), F.struct(F.lit(1).alias("side"), F.col("br").alias("b")))).alias("x"), "f").select("h", "x.side", "x.b", "f").where("b != 0")
    met = bands.groupBy("h", "side", "b").agg(F.min("f").alias("fl"), F.max("f").alias("fh")).where("fl < fh")
    mixed = bands.join(met, ["h", "side", "b"], "left_semi").select("f").distinct()
    one = classes.join(mixed, "f", "left_semi").groupBy(F.col("one.id").alias("id")).agg(F.collect_list(F.struct("f", "one.at", "one.before", "one.after")).alias("paragraphs"))

    def cut(batches):
        for b in batches:
            for text, at in zip(b.column(0).to_pylist(), b.column(1)):
                flat = at.values
                f, spot, before, after = (flat.field(n).to_numpy() for n in ("f", "at", "before", "after"))
                roll = Rolling(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
                # an id may have several texts: what isn't this one's is left out
                n = np.where(spot + shingle + after < len(roll.sums), before + after + shingle - span + 1, 0)
                n[n > 0] *= _fingerprints(roll, spot[n > 0], before[n > 0], after[n > 0], shingle) == f[n > 0]
                row = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) - before[row]
                h = roll.windows(shingle)
                mine = _slide(h, span - shingle + 1, np.minimum)[spot[row] + off] == h[spot[row]]
                row, off = row[mine], off[mine]
                start = spot[row] + off
                key = _mix(roll.between(start, start + span) ^ off.astype(np.uint64) * np.uint64(BASE)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[row]), pa.array(off.astype(np.int32)), pa.array(key)], names=["f", "off", "s"])

    texts = _text_rows(docs, span).join(broadcast_if_light(stage(one, "differing"), 100 + 32 * F.size("paragraphs")), "id")
    cuts = stage(texts.select("text", "paragraphs").mapInArrow(cut, "f bigint, off int, s bigint"), "stretches")
    sets = cuts.groupBy("s").agg(F.bit_xor(F.xxhash64("f")).alias("x"), F.count("*").alias("c")).where("c > 1")
    return cuts.join(sets, "s").select("f", "off", "x", "c")


def _sums(column: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(column)).alias("s1"), F.bit_xor(F.xxhash64(column, F.lit(1))).alias("s2")]


def sharers(docs: DataFrame, span: int = SPAN, shingle: int | None = None) -> DataFrame:
    """``g``, ``id``, ``n``: every different set ``g`` of (n) documents that have a stretch in common; staged.

    ``docs``: ``id``, ``text``; further columns are ignored.  Rows with a null
    id or text and texts shorter than ``span`` are in none; texts are compared
    code point by code point, whole; of rows with the same id every text counts
    for the document.  Sets are told apart by their size and two 64-bit sums of
    hashed ids, so a passage of any length is one set.
    """
    shingle = shingle or max(1, round(span * SHINGLE_SHARE))
    found = colliding(docs, span, shingle)
    members = found.select("f", "id").distinct()
    by_class = members.select(F.col("f").alias("x"), F.lit(0).cast("bigint").alias("c"), "id")
    kinds = _stretches(docs, found, span, shingle).select("f", "x", "c").distinct()
    by_stretch = members.join(kinds, "f").select("x", "c", "id").distinct()
    every = stage(by_class.unionByName(by_stretch), "sharing")
    sums = every.groupBy("x", "c").agg(*_sums(F.col("id"))).where("n > 1")
    one = sums.groupBy("n", "s1", "s2").agg(F.min(F.struct("x", "c")).alias("k")).select("n", F.struct("n", "s1", "s2").alias("g"), "k.*")
    return stage(every.join(one, ["x", "c"]).select("g", "id", "n"), "sharers")


def sharing_pairs(sets: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b``: documents that have a stretch in common, from ``sharers``."""
    return pairs_within(sets, "g").distinct()


def sharing_clusters(sets: DataFrame) -> DataFrame:
    """``id``, ``cluster_id`` (lowest id), ``cluster_size``: documents linked by common stretches, from ``sharers`` (bigint ids)."""
    from framelake.llm.components import connected_components

    least = sets.groupBy("g").agg(F.min("id").alias("a"))
    comp = connected_components(sets.join(least, "g").select("a", F.col("id").alias("b")).distinct())
    size = comp.groupBy("component").agg(F.count("*").alias("cluster_size"))
    return comp.join(size, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"), "cluster_size")


def shared_stretches(docs: DataFrame, span: int = SPAN, shingle: int | None = None) -> DataFrame:
    """``id``, ``a``, ``b``: places (from a, before b) that make up all stretches of ``span`` characters that another document has too; may overlap.

    Input as for ``sharers``.
    """
    shingle = shingle or max(1, round(span * SHINGLE_SHARE))
    found = colliding(docs, span, shingle)
    # a class of several documents shares its whole paragraph, any other what its common stretches cover around the anchor
    classes = found.groupBy("f").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    common = stage(_stretches(docs, found, span, shingle).groupBy("f", "x", "c").agg(F.min("off").alias("u"), (F.max("off") + span).alias("v")), "common")
    several = common.join(classes, "f").groupBy("x", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("x", "c")
    some = common.join(several, ["x", "c"], "left_semi").groupBy("f").agg(F.min("u").alias("u"), F.max("v").alias("v"))
    of = some.join(classes.where("lo < hi").select("f", F.lit(True).alias("all")), "f", "full").select("f", F.when(F.col("all").isNull(), F.col("u")).alias("u"), F.when(F.col("all").isNull(), F.col("v")).alias("v"))
    start, end = F.coalesce(F.col("u"), -F.col("before")), F.coalesce(F.col("v"), F.col("after") + shingle)
    return found.join(of, "f").select("id", (F.col("at") + start).alias("a"), (F.col("at") + end).alias("b")).distinct()


def shared_characters(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``chars``, ``shared_chars``, ``share`` of every document: how much of it lies in the places of ``shared_stretches``.

    Rows without an id are left out; rows with the same id have their places in common.
    """
    w = Window.partitionBy("id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(w), F.lit(0))))
    length = found.withColumn("_n", new).groupBy("id").agg(F.sum("_n").alias("shared"))
    sized = docs.where("id is not null").select("id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"))
    shared = F.coalesce("shared", F.lit(0).cast("bigint"))
    return sized.join(length, "id", "left").select("id", "chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("chars")), F.lit(0.0)).alias("share"))
