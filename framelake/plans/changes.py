"""Plan, diff and apply: bring a current state towards a desired one, by rule, and only by what is missing.

``plan`` gives one row per change (``key``, ``field``, ``old``, ``new``);
``apply`` gives the new state.  Planning against the applied state is empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.paths import prefixes
from framelake.functions.text import is_blank

#: Rules by name: whether and to what a field changes, from its current and desired value.
RULES = {
    "set": lambda old, new: F.when(new.isNotNull() & ~new.eqNullSafe(old), new),
    "fill_blank": lambda old, new: F.when(is_blank(old) & ~is_blank(new), new),
    "raise": lambda old, new: F.when(new > F.coalesce(old, new - 1), new),
    "if_zero": lambda old, new: F.when((F.coalesce(old, F.lit(0)) == 0) & (new != 0), new),
}


def plan(desired: DataFrame, current: DataFrame, key: str, rules: Mapping[str, str], protected: Column | None = None, still_allowed: Sequence[str] = (), unreadable: str | None = None) -> DataFrame:
    """``key``, ``field``, ``old``, ``new`` (text) of every change.

    ``rules`` maps fields to names of RULES.  Where ``protected`` (of the
    current row) holds, only ``still_allowed`` fields change.  ``unreadable``
    names a column of the current state with the fields that couldn't be read:
    unknown is never taken for empty, so these don't change.  Desired rows
    without a current one are not planned.
    """
    d = desired.select(key, *[F.col(f).alias(f"_d_{f}") for f in rules])
    j = current.join(d, key)
    guard = F.lit(False) if protected is None else F.coalesce(protected, F.lit(True))
    out = []
    for field, rule in rules.items():
        new = RULES[rule](F.col(field), F.col(f"_d_{field}"))
        if field not in still_allowed:
            new = F.when(~guard, new)
        if unreadable:
            new = F.when(~F.coalesce(F.array_contains(unreadable, field), F.lit(False)), new)
        out.append(F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("old"), new.cast("string").alias("new")))
    return j.select(key, F.explode(F.array(*out)).alias("c")).where("c.new is not null").select(key, "c.*")


def apply(current: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], expect_old: bool = True) -> DataFrame:
    """The state after ``changes``; with ``expect_old`` a change whose ``old`` is no longer current is skipped (compare and set)."""
    wide = changes.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.struct("old", "new"))).alias(f"_c_{f}") for f in fields])
    j = current.join(wide, key, "left")

    def value(f: str) -> Column:
        c, old = F.col(f"_c_{f}"), F.col(f)
        ok = c.isNotNull() & (old.cast("string").eqNullSafe(c.old) if expect_old else F.lit(True))
        return F.when(ok, c.new.try_cast(current.schema[f].dataType)).otherwise(old)

    return j.withColumns({f: value(f) for f in fields}).select(*current.columns)


def additions(desired: DataFrame, current: DataFrame, key: str, member: str) -> DataFrame:
    """Memberships (``key``, ``member``) that are desired and not there yet; members are compared in lower case, the first spelling is kept."""
    d = desired.where(f"{member} is not null").select(key, member, F.lower(member).alias("_f")).groupBy(key, "_f").agg(F.min(member).alias(member))
    return d.join(current.select(key, F.lower(member).alias("_f")).distinct(), [key, "_f"], "left_anti").select(key, member)


def hierarchy(paths: DataFrame, path: str, sep: str = "/") -> DataFrame:
    """Every ancestor of every path: ``node``, ``parent``, ``depth``, ``is_leaf`` (some path ends there), ``below`` (paths at or under it).

    Paths are counted by parent first, so only different parents are expanded.
    """
    parts = F.filter(F.split(path, "\\Q" + sep + "\\E"), lambda s: s != "")
    lead = F.when(F.col(path).startswith(sep), F.lit(sep)).otherwise(F.lit(""))
    one = paths.select(parts.alias("_a"), lead.alias("_l")).where(F.size("_a") > 0)
    leaf = one.select(F.concat("_l", F.array_join("_a", sep)).alias("node"), F.when(F.size("_a") > 1, F.concat("_l", F.array_join(F.slice("_a", F.lit(1), F.size("_a") - 1), sep))).alias("_up"), F.size("_a").alias("depth"))
    ends = leaf.groupBy("node", "depth").agg(F.count("*").alias("below"), F.lit(True).alias("is_leaf"))
    ups = leaf.where("_up is not null").groupBy("_up").agg(F.count("*").alias("_n")).select("_n", F.posexplode(prefixes(F.col("_up"), sep)).alias("_i", "node"))
    above = ups.groupBy("node").agg((F.min("_i") + 1).alias("depth"), F.sum("_n").alias("below"), F.lit(False).alias("is_leaf"))
    flat = ends.unionByName(above).groupBy("node").agg(F.min("depth").alias("depth"), F.bool_or("is_leaf").alias("is_leaf"), F.sum("below").alias("below"))
    parent = F.when(F.col("depth") > 1, F.regexp_replace("node", f"\\Q{sep}\\E[^{sep}]*$", ""))
    return flat.select("node", parent.alias("parent"), "depth", "is_leaf", "below")


def creation_order(wanted: DataFrame, existing: DataFrame, failed: DataFrame) -> DataFrame:
    """Nodes of a hierarchy still to be made: ``node``, ``depth``, ``state`` (``create``, or ``blocked`` under a failed ancestor), shallow ones first to be done."""
    todo = wanted.join(existing.select("node").distinct(), "node", "left_anti")
    up = todo.select("node", "depth", F.explode(prefixes(F.col("node"))).alias("_a"))
    bad = up.join(failed.select(F.col("node").alias("_a")).distinct(), "_a", "left_semi").select("node").distinct().withColumn("_bad", F.lit(True))
    return todo.join(bad, "node", "left").select("node", "depth", F.when(F.col("_bad"), "blocked").otherwise("create").alias("state"))


def first_match(rows: DataFrame, rules: Sequence[tuple[str, Column]], rest: str, name: str = "outcome") -> DataFrame:
    """Exactly one outcome per row: the first rule that holds."""
    cond = reduce(lambda acc, r: F.when(r[1], r[0]) if acc is None else acc.when(r[1], r[0]), rules, None)
    return rows.withColumn(name, cond.otherwise(rest) if cond is not None else F.lit(rest))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Rows by key, the greatest ``newest`` winning; at equality the row of ``new``."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in newest], F.desc("_side"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")


def merge_rounds(rounds: DataFrame, key: str, order: str, records: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One row per key: each record column from the latest round, each list column from the latest round where it isn't empty."""
    rec = [F.max_by(c, order).alias(c) for c in records]
    lis = [F.max_by(c, F.when(F.size(c) > 0, F.col(order))).alias(c) for c in lists]
    return rounds.groupBy(key).agg(*rec, *lis)


def correct(rows: DataFrame, corrections: DataFrame, key: str, fields: Sequence[str], order: str, implied: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Apply the last correction (``key``, ``field``, ``value`` text) of each field.

    ``implied`` maps a field to (other field, value) that a non-null correction
    of it sets as well.
    """
    last = corrections.groupBy(key, "field").agg(F.max_by(F.struct("value"), order).alias("s"))
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("s"))).alias(f"_c_{f}") for f in fields])
    j = rows.join(wide, key, "left")
    val = {f: F.when(F.col(f"_c_{f}").isNotNull(), F.col(f"_c_{f}").value.try_cast(rows.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    for f, (other, v) in (implied or {}).items():
        val[other] = F.when(F.col(f"_c_{f}").value.isNotNull(), F.lit(v)).otherwise(val.get(other, F.col(other)))
    return j.withColumns(val).select(*rows.columns)


def replay(lines: DataFrame, run: str) -> DataFrame:
    """State per item of one run's log: lines ``...\\tATTEMPT\\t<run>\\t<item>`` and ``...\\tOK\\t<run>\\t<item>\\t<result>``.

    ``line`` and ``at`` (order) come in; ``item``, ``state`` (``done``, or
    ``uncertain`` where only an attempt is recorded) and ``result`` go out.
    Lines of another shape or run are ignored.
    """
    f = F.split("line", "\t")
    field = lambda i: F.try_element_at(F.col("_f"), F.lit(i))
    rows = lines.withColumn("_f", f).withColumn("_k", F.array_position("_f", "OK")).withColumn("_k", F.when(F.col("_k") > 0, F.col("_k")).otherwise(F.array_position("_f", "ATTEMPT")).cast("int"))
    rows = rows.where("_k > 0").select("at", field(1).alias("_x"), F.try_element_at("_f", F.col("_k")).alias("kind"), F.try_element_at("_f", F.col("_k") + 1).alias("run"), F.try_element_at("_f", F.col("_k") + 2).alias("item"), F.try_element_at("_f", F.col("_k") + 3).alias("result"))
    ok = F.col("kind") == "OK"
    return rows.where((F.col("run") == run) & F.col("item").isNotNull()).groupBy("item").agg(F.max(ok).alias("_ok"), F.max_by("result", F.when(ok, F.col("at"))).alias("result")).select("item", F.when(F.col("_ok"), "done").otherwise("uncertain").alias("state"), F.when(F.col("_ok"), F.col("result")).alias("result"))


def copy_state(rows: DataFrame, tagged: str, complete: str, named: str, readable: str) -> DataFrame:
    """What to do about a derived copy, from four boolean columns (null: false), first rule that holds: unreadable, done, pending, untagged but so named, else create."""
    t, c, n, r = (F.coalesce(F.col(x), F.lit(False)) for x in (tagged, complete, named, readable))
    return first_match(rows, [("skip_unreadable", ~r), ("done", t & c), ("complete", t), ("skip_untagged", n)], "create", "action")


def finish_list(rows: DataFrame, tag: str, wanted_tag: Column, member: str) -> DataFrame:
    """Which finished items still need their tag or their membership; rows that need neither are left out."""
    return rows.withColumns({"need_tag": ~F.col(tag).eqNullSafe(wanted_tag), "need_member": ~F.coalesce(F.col(member), F.lit(False))}).where("need_tag or need_member")


def verify_created(claims: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Each claim (``path``, ``item_id``) with ``ok``: the id is new, claimed once, and found under that path afterwards."""
    n = F.count("*").over(Window.partitionBy("item_id"))
    old = before.select("item_id").distinct().withColumn("_old", F.lit(True))
    at = after.select("path", "item_id").distinct().withColumn("_at", F.lit(True))
    j = claims.withColumn("_n", n).join(old, "item_id", "left").join(at, ["path", "item_id"], "left")
    return j.select("path", "item_id", (F.col("_old").isNull() & (F.col("_n") == 1) & F.col("_at").isNotNull()).alias("ok"))
