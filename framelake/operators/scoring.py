"""Standardised blends and measures of a score's quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.physical import range_sorted, running_sum


def zscores(rows: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Population z-scores over the whole table, NaN and null left out of the statistics and scored 0; a zero deviation counts as 1.

    Two passes: the statistics are one row, joined back by a broadcast.
    """
    ok = {c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    stats = rows.agg(*[f(ok[c]).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).withColumn("_key", F.lit(1))
    j = rows.withColumn("_key", F.lit(1)).join(F.broadcast(stats), "_key")
    z = {c + suffix: F.coalesce((ok[c] - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), F.lit(0.0)) for c in columns}
    return j.withColumns(z).drop("_key", *[f"_{k}_{c}" for c in columns for k in "ms"])


def blend(rows: DataFrame, weights: Mapping[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of the z-scores of the columns."""
    cols = list(weights)
    z = zscores(rows, cols)
    return z.withColumn(name, sum((F.col(f"{c}_z") * w for c, w in weights.items()), F.lit(0.0))).drop(*[f"{c}_z" for c in cols])


def _value_counts(rows: DataFrame, keys: Sequence[str], value: str, *aggregates) -> DataFrame:
    """Different values per key with ``_c`` (rows), ``_upto`` (rows up to and with it) and the aggregates; range-sorted, so a key may have any number of values."""
    each = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"), *aggregates)
    return running_sum(range_sorted(each, [*map(F.col, keys), F.col(value)], "values"), list(keys), F.col("_c"), "_upto").drop("_part", "_row")


def _with_total(values: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``values`` with ``_n``, the rows of their key."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumn("_one", F.lit(1))
    on = [F.col("_1") == F.col("_one"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return values.withColumn("_1", F.lit(1)).join(n, on).drop("_1", "_one", *[f"_k{i}" for i in range(len(keys))])


def _rank_sums(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives, negatives and the sum of average ranks of positives per key, from counts of each different score."""
    usable = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    each = _value_counts(usable, keys, score, F.count_if(F.col(label)).alias("_p"))
    return each.withColumn("_r", F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).groupBy(*keys).agg(F.sum("_p").alias("pos"), (F.sum("_c") - F.sum("_p")).alias("neg"), F.sum(F.col("_p") * F.col("_r")).alias("_ranks"))


def auc(rows: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per key (Mann-Whitney with average ranks); keys without both classes are left out.

    ``label`` is boolean.  Equal scores are counted first, so the ordered part
    runs over different scores only.
    """
    s = _rank_sums(rows, keys, score, label).where("pos > 0 and neg > 0")
    return s.select(*keys, "pos", "neg", ((F.col("_ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def percentile_ladder(rows: DataFrame, value: str, percents: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """The value at 0-based index floor(n * p / 100) of the ascending order, per percent."""
    usable = rows.where(F.col(value).isNotNull())
    run = _with_total(_value_counts(usable, keys, value), usable, keys)
    asked = run.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("_i", F.least(F.expr("_n * percent div 100"), F.col("_n") - 1))
    return asked.where("_upto > _i and _upto - _c <= _i").select(*keys, "percent", value)


def linear_percentiles(rows: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Percentiles by linear interpolation, exact, one row per share; a key without a value has none.

    Read off from the counts of different values, so no task holds a key's values.
    """
    usable = rows.where(F.col(value).isNotNull())
    run = _with_total(_value_counts(usable, keys, value), usable, keys)
    asked = run.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_h", (F.col("_n") - 1) * F.col("share"))
    low, high, v = F.floor("_h"), F.ceil("_h"), F.col(value).cast("double")
    has = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_c") <= i)
    ends = asked.where(has(low) | has(high)).groupBy(*keys, "share", "_h").agg(F.max(F.when(has(low), v)).alias("_a"), F.max(F.when(has(high), v)).alias("_b"))
    return ends.select(*keys, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias(value))


def shares(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``of_max`` and ``of_total``: the value against the greatest and the sum of its group, 0 where these are 0."""
    stat = rows.groupBy(*keys).agg(F.max(value).alias("_m"), F.sum(value).alias("_t")).withColumn("_key", F.lit(1))
    on = ["_key", *keys]
    part = lambda c: F.coalesce(F.try_divide(F.col(value), F.nullif(F.col(c), F.lit(0))), F.lit(0.0))
    return rows.withColumn("_key", F.lit(1)).join(stat, on).withColumns({"of_max": part("_m"), "of_total": part("_t")}).drop("_m", "_t", "_key")
