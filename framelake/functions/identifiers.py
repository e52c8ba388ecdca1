"""Column builders that read numbers and names from dirty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: ASCII controls and every Unicode space.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def hex64(text: Column) -> Column:
    """A 64-bit number written in hex, as a signed bigint; null if there is none or it is zero.

    Letter case, white space, the separators ``-`` and ``:``, a prefix ``0x``
    and lost leading zeros don't matter.
    """
    s = F.lower(F.regexp_replace(text, SPACE[:-1] + r":\-]", ""))
    s = F.regexp_replace(F.regexp_replace(s, "^0x", ""), "^0+", "")
    ok = s.rlike("^[0-9a-f]{1,16}$")
    p = F.when(ok, F.lpad(s, 16, "0"))
    hi, lo = (F.conv(F.substring(p, i, 8), 16, 10).cast("bigint") for i in (1, 9))
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def whole_number(text: Column) -> Column:
    """Digits, perhaps padded by white space, with a sign or a zero decimal tail, as a bigint; else null."""
    s = F.regexp_replace(text, SPACE, "")
    digits = F.regexp_extract(s, r"^(\+?-?\d{1,18})(?:\.0*)?$", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^\+", "").try_cast("bigint"))


def squeezed(text: Column) -> Column:
    """Lower case, trimmed, each run of white space as one space; null if nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(text), SPACE + "+", " "))
    return F.when(s != "", s)
