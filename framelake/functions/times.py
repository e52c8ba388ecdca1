"""Column builders for local times kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_seconds(text: Column) -> Column:
    """Seconds since 1970 of the local time in the first 19 characters, as a bigint without any zone.

    Date fields are parted by ``-`` or ``:``, date and time by ``T`` or a
    space; what follows (fraction, offset) is ignored.  Null where there is no
    full, valid date and time.
    """
    m = r"^(\d{4})[-:](\d\d)[-:](\d\d)[T ](\d\d):(\d\d):(\d\d)$"
    s = F.substring(text, 1, 19)
    part = lambda i: F.regexp_extract(s, m, i)
    day = F.unix_date(F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")).cast("bigint")
    h, mi, se = (part(i).try_cast("int") for i in (4, 5, 6))
    ok = s.rlike(m) & (part(1) != "0000") & (h < 24) & (mi < 60) & (se < 60)
    return F.when(ok, day * 86400 + h * 3600 + mi * 60 + se)


def local_text(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` of seconds since 1970, whatever the session's zone."""
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), two(F.pmod(rest, F.lit(60))))
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock)
