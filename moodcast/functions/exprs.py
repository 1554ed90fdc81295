"""Scalar column functions (SURVEY FN-*). Each returns a ``Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodcast import params as P

__all__ = [
    "col_", "time_bucket", "log_score", "composite", "details_composite",
    "abs_sentiment", "effect", "scale_0_10", "round_half_up", "text_length",
    "content_hash", "absolute_url", "url_slug", "parse_us_date", "parse_number",
    "parse_epoch_text", "epoch_to_local", "local_label", "epoch_point",
    "is_stale", "series_visible", "sentiment_label", 
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bucket(c, seconds: int) -> Column:
    """FN-1: ``floor(c / w) * w`` as bigint, UTC aligned; negatives floor down."""
    return (F.floor(col_(c) / F.lit(float(seconds))) * F.lit(int(seconds))).cast("bigint")


def log_score(score) -> Column:
    """``ln(score)`` when score > 0, else NULL (callers decide the fallback)."""
    s = col_(score)
    return F.when(s > 0, F.log(s.cast("double")))


def composite(sentiment, score) -> Column:
    """FN-2: sentiment * (score > 0 ? ln(score) : 0); NULL sentiment stays NULL.

    Rounded to nine places (``COMPOSITE_DECIMAL``) so every executor and engine
    agrees on the bits whatever its ``ln`` implementation.
    """
    raw = col_(sentiment) * F.coalesce(log_score(score), F.lit(0.0))
    return raw.cast(P.COMPOSITE_DECIMAL).cast("double")


def round_half_up(c, digits: int) -> Column:
    """Round on the decimal value, half away from zero, back to double.

    Rounding the double directly differs between engines on ties (1.005);
    going through a decimal makes the rule exact and engine independent.
    """
    return F.round(col_(c).cast("decimal(38,9)"), digits).cast("double")


def details_composite(sentiment, score) -> Column:
    """FN-3: round(sentiment, 3) * ln(score); any missing or invalid input -> 0."""
    raw = round_half_up(sentiment, 3) * log_score(score)
    return F.coalesce(raw.cast(P.COMPOSITE_DECIMAL).cast("double"), F.lit(0.0))


def abs_sentiment(c) -> Column:
    """FN-4."""
    return round_half_up(F.abs(col_(c)), 2)


def effect(c) -> Column:
    """FN-5: 'positive' when >= 0 (so 0 is positive), else 'negative'."""
    return F.when(col_(c) >= 0, F.lit("positive")).otherwise(F.lit("negative"))


def scale_0_10(v, mn, mx) -> Column:
    """FN-6: min-max scale to 0..10; a constant series gives NULL, not an error."""
    v, mn, mx = col_(v), col_(mn), col_(mx)
    return F.when(mx > mn, F.lit(10.0) * (v - mn) / (mx - mn))


def text_length(c) -> Column:
    """PRJ-3: code points; NULL or empty -> 0."""
    return F.coalesce(F.char_length(col_(c)), F.lit(0)).cast("int")


def content_hash(title, body, version: str = P.SCORER_VERSION) -> Column:
    """FN-9: hex sha256 of version + title + body."""
    return F.sha2(F.concat(F.lit(version), col_(title), col_(body)), 256)


def absolute_url(path, base: str = P.URL_BASE) -> Column:
    """FN-10."""
    return F.concat(F.lit(base), col_(path))


def url_slug(url) -> Column:
    """FN-11: URL path, '/' trimmed at both ends, last segment."""
    path = F.coalesce(F.try_parse_url(col_(url), F.lit("PATH")), F.lit(""))
    trimmed = F.regexp_replace(path, r"^/+|/+$", "")
    return F.when(col_(url).isNotNull(), F.element_at(F.split(trimmed, "/"), -1))


def parse_us_date(s) -> Column:
    """FN-12: month/day/year (padded or not, as %m/%d/%Y accepts) to the epoch
    of that UTC midnight; bad text -> NULL.

    Built from the parsed date, so the session time zone plays no part.
    """
    d = F.try_to_timestamp(F.trim(col_(s)), F.lit("M/d/yyyy")).cast("date")
    return (F.unix_date(d).cast("bigint") * F.lit(P.DAY))


def parse_number(s) -> Column:
    """FN-13: '1,012.50' -> 1012.5; bad text -> NULL."""
    return F.regexp_replace(F.trim(col_(s)), ",", "").try_cast("double")


def parse_epoch_text(s) -> Column:
    """FN-14: int(float(s))."""
    return col_(s).try_cast("double").cast("bigint")


def epoch_to_local(e, tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` of an epoch, as timestamp_ntz (session zone unused)."""
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), col_(e).cast("decimal(18,6)"))
    if tz.upper() == "UTC":
        return ntz
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ntz)


def local_label(e, fmt: str, tz: str = "UTC") -> Column:
    """FN-16: formats such as 'yyyy-MM-dd HH'h'' of an epoch in ``tz``."""
    return F.date_format(epoch_to_local(e, tz), fmt)


def epoch_point(e) -> Column:
    """FN-18: the epoch as a UTC point in time (timestamp_ntz)."""
    return epoch_to_local(e, "UTC")


def is_stale(newest, as_of: int, limit_s: int) -> Column:
    """FN-17: table empty, or its newest row older than ``as_of - limit`` (strict)."""
    n = col_(newest)
    return n.isNull() | (n < F.lit(int(as_of - limit_s)))


def series_visible(name, visible=P.DEFAULT_VISIBLE) -> Column:
    """FIL-8."""
    return col_(name).isin(list(visible))


def sentiment_label(c, cut: float = P.LABEL_CUT) -> Column:
    """TXT-4: Positive / Negative / Neutral at +-cut."""
    v = col_(c)
    return (F.when(v >= cut, F.lit("Positive"))
            .when(v <= -cut, F.lit("Negative"))
            .when(v.isNotNull(), F.lit("Neutral")))
