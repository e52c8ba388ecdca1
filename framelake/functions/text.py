"""Column builders for names and other short texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def fold_name(s: pd.Series) -> pd.Series:
    """Canonical composition, then case folding; null stays null.

    The JVM has no function for either, so this is an Arrow-batched UDF; where
    names are ASCII, ``F.lower`` gives the same.
    """
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def folded(text: Column) -> Column:
    """``fold_name`` where it differs from lower case: ASCII texts are folded in the JVM and reach Python as nulls."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, fold_name(F.when(foreign, text))).otherwise(F.lower(text))


def loose_fold(text: Column) -> Column:
    """ASCII lower case with every run of a base letter and its marks, or of other non-ASCII characters, as one ``?``.

    Two spellings of an accented name fold alike, whichever way it is composed.
    """
    s = F.regexp_replace(text, r"[A-Za-z]\p{M}+", "?")
    s = F.regexp_replace(s, r"[^\x00-\x7F]\p{M}*", "?")
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tail_int(text: Column, sep: str = ":", need_sep: bool = True) -> Column:
    """The last ``sep`` field as a bigint, null if it is no number (or, with ``need_sep``, if there is no ``sep``)."""
    last = F.element_at(F.split(text, "\\Q" + sep + "\\E"), -1).try_cast("bigint")
    return F.when(text.contains(sep), last) if need_sep else last


def slug(text: Column, longest: int = 80) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, no hyphen at the ends."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, longest)


def split_trim(text: Column, sep: str) -> Column:
    """Trimmed, non-empty fields."""
    return F.filter(F.transform(F.split(text, "\\Q" + sep + "\\E"), lambda x: F.trim(x)), lambda x: x != "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | (F.trim(text) == "")


def append_label(labels: Column, new: Column) -> Column:
    """``new`` added to a comma list, which may be null or empty."""
    return F.when(is_blank(labels), new).otherwise(F.concat_ws(",", labels, new))


def joined_labels(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order, as a comma list (empty if none does)."""
    return F.concat_ws(",", *[F.when(cond, F.lit(name)) for cond, name in rules])


def holds(cond: Column) -> Column:
    """1 where a three-valued condition is true, 0 where it is false or unknown."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def canonical_error(text: Column, longest: int = 500) -> Column:
    """Numbers as ``#`` and quoted parts as ``'..'``, so that messages of one kind are equal; at most ``longest`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"'[^']*'", "'..'"), r"\d+", "#"), 1, longest)


def json_for_page(value: Column) -> Column:
    """JSON text that may stand inside a script element: ``</`` is escaped."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def first_match(value: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first (name, pattern) that is found in the value, whatever the case; null counts as ``other``."""
    out = None
    for name, pattern in rules:
        cond = value.rlike("(?i)" + pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(other) if out is None else out.otherwise(other)
