"""Small labels and conversions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.urls import host_col


def where_all(df: DataFrame, **conditions: object) -> DataFrame:
    """Rows that equal every condition given; conditions that are None don't count."""
    wanted = [F.col(c) == F.lit(v) for c, v in conditions.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, wanted)) if wanted else df


def same_host(a: Column, b: Column) -> Column:
    """Two URLs have one host (`www.` isn't folded); false where either has none."""
    return F.coalesce(host_col(a) == host_col(b), F.lit(False))


def days_since(stamp: Column, as_of: str) -> Column:
    """Days from stamp to as_of, not under 0; null for null."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / 86_400_000_000
    return F.when(stamp.isNotNull(), F.greatest(F.lit(0.0), days))


def iso_stamp(text: Column) -> Column:
    """A date or time text as ISO in UTC, null where it is none."""
    t = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def priority(level: Column) -> Column:
    """critical from 4, high from 3, medium from 2, else low."""
    return F.when(level >= 4, "critical").when(level >= 3, "high").when(level >= 2, "medium").otherwise("low")


def search_intent(path: Column, query: Column) -> Column:
    """Intent of a query that leads to a path; the first match counts."""
    hay = F.lower(F.concat_ws(" ", path, query))
    # fixed values: words by intent
    return F.when(hay.rlike("pris|priser|bestill|booking|book|reservasjon|kontakt"), "transactional").when(hay.rlike("vs|beste|alternativ|sammenlign|review|hva bør du velge"), "commercial investigation").otherwise("informational")


def brand_name(publisher: Column, author: Column, url: Column) -> Column:
    """Publisher, else author, else the host's first label with a capital (without `www.`)."""
    label = F.regexp_extract(F.regexp_replace(host_col(url), r"^www\.", ""), r"^([^.]+)", 1)
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(publisher), some(author), F.concat(F.upper(F.substring(label, 1, 1)), label.substr(F.lit(2), F.length(label))))


def clamp_days(days: Column, least: int = 7, most: int = 365, default: int = 90) -> Column:
    """Days as a whole number within bounds; the default for null."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(days, F.lit(default))))


def seconds_left(elapsed: Column, percent: Column) -> Column:
    """Seconds a run still takes at its pace; null before it has begun or once it is over."""
    return F.when((percent > 0) & (percent < 100), F.floor(elapsed / percent * (100 - percent) + 0.5))
