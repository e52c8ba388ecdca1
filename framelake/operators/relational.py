"""Reconciliation, verification and classification of one collection against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import paths, text


def best_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, which should end in a unique column.

    One shuffle; every task keeps a single row of a key before it (the window
    has a group limit), so hot keys cost nothing.  A null key is a key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Column, *cols: str) -> DataFrame:
    """As ``best_by`` for a few columns, as a hash aggregation: the struct with the least ``order`` wins."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in cols])


def _with_fold(rows: DataFrame, column: str = "name") -> DataFrame:
    return rows if "fold" in rows.columns else rows.withColumn("fold", text.folded(F.col(column)))


def reconcile(declared: DataFrame, observed: DataFrame, scope: Sequence[str] = (), sidecars: DataFrame | None = None) -> DataFrame:
    """Match declared names with observed ones, both ways.

    ``declared``: ``scope``, ``name``, ``key``; ``observed``: ``scope``,
    ``name``.  Within a scope a declared name is ``present`` if it is observed
    exactly, ``spelling_equivalent`` if not but exactly one observed name has
    the same folded form (column ``match`` has it), else ``absent``.  Observed
    names that match no declared one in either way are ``extra`` (null key), or
    ``companion`` if their folded form is among ``sidecars`` (``scope``,
    ``name``), the names that files beside the declared ones may have.
    Null names match nothing; repeated observed names count once.  Names are
    compared folded by ``fold`` columns if given, else by ``text.folded``
    (composed and case-folded).
    """
    scope = list(scope)
    given = ["fold"] if "fold" in observed.columns else []
    seen = _with_fold(observed.where("name is not null").select(*scope, "name", *given).distinct())
    folded = seen.groupBy(*scope, "fold").agg(F.count("*").alias("_n"), F.min("name").alias("_one"), F.collect_set("name").alias("_all"))
    d = _with_fold(declared).select(*scope, "key", "name", "fold")
    j = d.join(folded, [*scope, "fold"], "left")
    exact = F.coalesce(F.array_contains("_all", F.col("name")), F.lit(False))
    state = F.when(exact, "present").when(F.col("_n") == 1, "spelling_equivalent").otherwise("absent")
    match = F.when(exact, F.col("name")).when(F.col("_n") == 1, F.col("_one"))
    hits = j.select(*scope, "key", "name", state.alias("state"), match.alias("match"))
    used = hits.where("match is not null").select(*scope, F.col("match").alias("name")).distinct()
    rest, state = seen.join(used, [*scope, "name"], "left_anti"), F.lit("extra")
    if sidecars is not None:
        beside = _with_fold(sidecars.where("name is not null")).select(*scope, "fold").distinct().withColumn("_beside", F.lit(True))
        rest, state = rest.join(beside, [*scope, "fold"], "left"), F.when(F.col("_beside"), "companion").otherwise("extra")
    extra = rest.select(*scope, F.lit(None).cast(declared.schema["key"].dataType).alias("key"), "name", state.alias("state"), F.col("name").alias("match"))
    return hits.unionByName(extra)


def tally(states: DataFrame, keys: Sequence[str], state: str, values: Sequence[str]) -> DataFrame:
    """One row per ``keys`` with a count for each state, the total, and whether the counts add up to it."""
    counts = [F.count_if(F.col(state) == v).alias(v) for v in values]
    out = states.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("complete", F.col("total") == sum((F.col(v) for v in values), F.lit(0)))


def name_and_size_hits(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Every found file of a wanted name (any case and composition), with ``size_match``; null sizes match nothing.

    ``wanted``: ``key``, ``name``, ``size``; ``found``: ``path``, ``name``,
    ``size``.  Names are compared by ``fold`` columns if given, else by ``text.folded``.
    """
    w = _with_fold(wanted).select("key", F.col("fold").alias("_f"), F.col("size").alias("wanted_size"))
    f = _with_fold(found).select("path", F.col("fold").alias("_f"), F.col("size").alias("found_size"))
    return w.join(f, "_f").select("key", "path", "wanted_size", "found_size", F.coalesce(F.col("wanted_size") == F.col("found_size"), F.lit(False)).alias("size_match"))


def best_hit(hits: DataFrame) -> DataFrame:
    """The hit of each key with a matching size, else the first by path."""
    return first_by_key(hits, ["key"], F.struct((~F.col("size_match")).alias("a"), F.col("path").alias("b")), "path", "found_size", "size_match")


def verify_candidates(candidates: DataFrame, missing: DataFrame, known: DataFrame) -> DataFrame:
    """A verdict for each proposed replacement of a missing item, by two attributes.

    ``candidates``: ``key``, ``candidate``; ``missing``: ``key``, ``time``,
    ``size``; ``known``: ``candidate``, ``time``, ``size``.  Verdicts, best
    first: ``same`` (both equal), ``same_time``, ``same_size``, ``different``,
    ``not_known`` (candidate without a record), ``unknown_key``.  A null
    attribute equals nothing.
    """
    m = missing.select("key", F.col("time").alias("_mt"), F.col("size").alias("_ms"), F.lit(True).alias("_m"))
    k = known.select("candidate", F.col("time").alias("_kt"), F.col("size").alias("_ks"), F.lit(True).alias("_k"))
    j = candidates.join(m, "key", "left").join(k, "candidate", "left")
    t, s = F.coalesce(F.col("_mt") == F.col("_kt"), F.lit(False)), F.coalesce(F.col("_ms") == F.col("_ks"), F.lit(False))
    verdict = F.when(F.col("_m").isNull(), "unknown_key").when(F.col("_k").isNull(), "not_known").when(t & s, "same").when(t, "same_time").when(s, "same_size").otherwise("different")
    return j.select("key", "candidate", verdict.alias("verdict"))


#: Verdicts in falling order of worth.
VERDICTS = ("same", "same_time", "same_size", "different", "not_known", "unknown_key")


def best_verdict(verdicts: DataFrame) -> DataFrame:
    """The best verdict of each key, ties by candidate."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return first_by_key(verdicts, ["key"], F.struct(rank.alias("a"), F.col("candidate").alias("b")), "candidate", "verdict")


def classify_files(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Where each listed file stands towards a catalog, first rule that holds.

    Both have ``path`` and ``size``.  ``cataloged``: the path is known;
    ``sibling``: a cataloged file of that folder has its stem; ``copy``: a
    cataloged file has its name and size; ``repeat``: an earlier listed file (by
    path) has its name and size; else ``new``.  Paths are compared by ``fold``
    columns if given, else by ``text.folded``; null sizes are equal to none.
    """
    p = F.col("fold")
    key = lambda df: _with_fold(df.where("path is not null"), "path").select("path", "size", p.alias("p"), paths.basename(p).alias("n"), F.concat(paths.dirname(p), F.lit("/"), paths.stem(p)).alias("ds"))
    f, c = key(listing), key(catalog)
    flag = lambda keys, name: c.select(*keys).distinct().withColumn(name, F.lit(True))
    j = f.join(flag(["p"], "_a"), "p", "left").join(flag(["ds"], "_b"), "ds", "left").join(flag(["n", "size"], "_c"), ["n", "size"], "left")
    rest = j.withColumn("_r", F.coalesce(F.col("_a"), F.col("_b"), F.col("_c")).isNull())
    w = Window.partitionBy("n", "size", "_r").orderBy("path")
    repeat = F.col("_r") & F.col("size").isNotNull() & (F.row_number().over(w) > 1)
    state = F.when(F.col("_a"), "cataloged").when(F.col("_b"), "sibling").when(F.col("_c"), "copy").when(repeat, "repeat").otherwise("new")
    return rest.select("path", "size", state.alias("state"))


def with_dimensions(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Sequence[str], dict[str, object]]]) -> DataFrame:
    """Left-join dimensions in turn; each is (rows with unique keys, keys, {column: default for a missing row})."""
    out = fact
    for rows, keys, defaults in dimensions:
        out = out.join(rows, list(keys), "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None})
    return out


def resolve_identity(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Find each entry's item by uuid, else by path, else by id; refuse contradictions.

    ``entries``: ``entry``, ``uuid``, ``path``, ``item_id``; ``items``:
    ``item_id``, ``uuid``, ``path``.  A path that several items have is
    ``ambiguous``; one whose item has another id than the entry names is a
    ``conflict``.  Several entries of one item: the first (by ``entry``) is
    kept, the others are ``repeat``.
    """
    by_uuid = items.where("uuid is not null").groupBy("uuid").agg(F.min("item_id").alias("_u"))
    by_path = items.where("path is not null").groupBy("path").agg(F.min("item_id").alias("_p"), F.count_distinct("item_id").alias("_pn"))
    by_id = items.select(F.col("item_id").alias("_i")).distinct()
    j = entries.join(by_uuid, "uuid", "left").join(by_path, "path", "left").join(by_id, F.col("item_id") == F.col("_i"), "left")
    conflict = F.col("_u").isNull() & F.col("_p").isNotNull() & F.col("item_id").isNotNull() & (F.col("_p") != F.col("item_id"))
    how = F.when(F.col("_u").isNotNull(), "uuid").when(F.col("_pn") > 1, "ambiguous").when(conflict, "conflict").when(F.col("_p").isNotNull(), "path").when(F.col("_i").isNotNull(), "id").otherwise("not_found")
    j = j.withColumn("how", how).withColumn("resolved", F.when(F.col("how") == "uuid", F.col("_u")).when(F.col("how") == "path", F.col("_p")).when(F.col("how") == "id", F.col("_i")))
    again = F.col("resolved").isNotNull() & (F.row_number().over(Window.partitionBy("resolved").orderBy("entry")) > 1)
    # entries that aren't resolved are no group to number: they are kept apart
    found = j.where("resolved is not null").withColumn("how", F.when(again, "repeat").otherwise(F.col("how")))
    return found.unionByName(j.where("resolved is null")).select("entry", "resolved", "how")


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``, the longest path of ``roots`` (column ``root``) that is the path or an ancestor of it; else null.

    Paths are exploded to their prefixes and joined by equality; no range join.
    The result has a row for each row, told apart by all columns.
    """
    known = roots.where("root is not null").select("root", F.lower("root").alias("_k")).groupBy("_k").agg(F.min("root").alias("root"))
    at = rows.select(F.col(path)).where(F.col(path).isNotNull()).distinct()
    hit = at.select(F.col(path), F.explode(paths.prefixes(F.lower(path))).alias("_k")).join(known, "_k").groupBy(path).agg(F.max_by("root", F.length("_k")).alias("root"))
    return rows.join(hit, path, "left")


def pick_mirror(files: DataFrame, mirrors: DataFrame) -> DataFrame:
    """The first mirror (by ``rank``) that holds a file of the wanted size, else null.

    ``files``: ``key``, ``size``; ``mirrors``: ``key``, ``rank``, ``path``, ``size``.
    """
    good = files.join(mirrors.withColumnRenamed("size", "_s"), "key").where("size = _s").groupBy("key").agg(F.min_by("path", "rank").alias("mirror"))
    return files.join(good, "key", "left").select("key", "size", "mirror")


def rejects(corrections: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Corrections (``id``, ``field``, ``value``, ``reason``) that may not be applied, with ``why``: unknown field, no reason, or repeated (id, field)."""
    n = F.count("*").over(Window.partitionBy("id", "field"))
    why = F.when(~F.coalesce(F.col("field").isin(*allowed), F.lit(False)), "field").when(F.col("reason").isNull() | (F.trim("reason") == ""), "reason").when(F.col("_n") > 1, "repeated")
    return corrections.withColumn("_n", n).withColumn("why", why).drop("_n").where("why is not null")


def first_where(rows: DataFrame, keys: Sequence[str], good: Column, place: str) -> DataFrame:
    """Each key's first row (by ``place``) for which ``good`` holds, else its first row."""
    w = Window.partitionBy(*keys).orderBy((~F.coalesce(good, F.lit(False))).cast("int"), place)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def override(rows: DataFrame, final: DataFrame, key: str, column: str, inside: str, outside: str, sticky: Sequence[str] = ()) -> DataFrame:
    """``column`` set by membership of ``key`` in ``final``; rows whose value is in ``sticky`` keep it."""
    f = final.select(key).distinct().withColumn("_in", F.lit(True))
    value = F.when(F.col(column).isin(*sticky), F.col(column)).when(F.col("_in"), inside).otherwise(outside)
    return rows.join(f, key, "left").withColumn(column, value).drop("_in")


def normalised(rows: DataFrame, texts: Sequence[str] = (), ranges: dict[str, tuple[int, int]] | None = None, choices: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Trim texts (blank: null), drop whole numbers out of range and unknown choices (in lower case), and say so in ``warnings`` (array of field names)."""
    ranges, choices = ranges or {}, choices or {}
    new = {c: F.nullif(F.trim(c), F.lit("")) for c in texts}
    new |= {c: F.when(F.floor(c).between(*b), F.floor(c)) for c, b in ranges.items()}
    new |= {c: F.when(F.lower(F.trim(c)).isin(*v), F.lower(F.trim(c))) for c, v in choices.items()}
    lost = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") & new[c].isNull(), F.lit(c)) for c in (*ranges, *choices)]
    warnings = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
    return rows.withColumns(new | {"warnings": warnings})
