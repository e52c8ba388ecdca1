"""Column builders for slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """What comes before the last slash; empty if there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none.  A leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def with_extension(path: Column, ext: str) -> Column:
    name = F.concat(stem(path), F.lit("." + ext))
    return F.when(path.contains("/"), F.concat(dirname(path), F.lit("/"), name)).otherwise(name)


def segment_year(path: Column, after: int = 1900, before: int = 2100) -> Column:
    """The first path segment of four digits strictly between ``after`` and ``before``, as text; null if none."""
    four = F.filter(F.split(path, "/"), lambda s: s.rlike(r"^\d{4}$"))
    years = F.filter(four, lambda s: (s.try_cast("int") > after) & (s.try_cast("int") < before))
    return F.try_element_at(years, F.lit(1))


def year_cascade(path: Column, modified: Column) -> Column:
    """struct(year, source): from the file name, else the folder, else the time of modification, else null."""
    in_name = F.nullif(F.regexp_extract(basename(path), r"(?:^|\D)((?:19|20)\d\d)[-_]?(?:0[1-9]|1[0-2])", 1), F.lit(""))
    in_dir = segment_year(dirname(path))
    of_time = F.date_format(modified, "yyyy")
    year = F.coalesce(in_name, in_dir, of_time)
    source = F.when(in_name.isNotNull(), "name").when(in_dir.isNotNull(), "folder").when(of_time.isNotNull(), "time")
    return F.struct(year.alias("year"), source.alias("source"))


def prefixes(path: Column, sep: str = "/") -> Column:
    """All ancestors of a hierarchical name and the name itself, shortest first; empty levels are skipped."""
    parts = F.filter(F.split(path, "\\Q" + sep + "\\E"), lambda s: s != "")
    lead = F.when(path.startswith(sep), F.lit(sep)).otherwise(F.lit(""))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(lead, F.array_join(F.slice(parts, F.lit(1), i), sep)))).otherwise(F.array().cast("array<string>"))


def shard_path(number: Column, suffix: str = "") -> Column:
    """``0012/12345suffix``: thousands as a folder of at least four digits."""
    folder = F.floor(number / 1000).cast("string")
    return F.concat(F.when(F.length(folder) < 4, F.lpad(folder, 4, "0")).otherwise(folder), F.lit("/"), number.cast("string"), F.lit(suffix))


def in_bucket(path: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule (prefix, name) whose prefix the path starts with."""
    out = None
    for prefix, name in rules:
        out = F.when(path.startswith(prefix), name) if out is None else out.when(path.startswith(prefix), name)
    return F.lit(other) if out is None else out.otherwise(other)
