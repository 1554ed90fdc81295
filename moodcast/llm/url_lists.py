"""URL filters with dated lists: a temporal join of captures and list entries.

List entries come and go: each dated change (``add`` or ``remove`` of a key in a
list) becomes the validity interval until the key's next change, and every
capture is judged by the entries active at its fetch time. A key is a host, a
parent domain, or a host with a path prefix; the longest key decides, ``block``
before ``allow`` among keys of one length.

Both sides are cut at fixed time spans, so the captures of a frequent host meet
only the intervals of their span, and no (key, list) has to be ordered as a
whole: the next change is found within a span, and across spans from one row for
each span. Captures are judged once for each (URL, time).

Defined cases: a null or host-less URL and a null time match nothing (verdict
null); entries with a null key, list, action or time are ignored; of changes of
one key in one list at one time a removal counts, else the last verdict in order; repeated entries count
once; repeated captures are all returned; a change takes effect at its time and
ends just before the next; an empty table on either side gives no match; extra
columns of the captures are kept, unless they clash with the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_SECONDS = 30 * 86_400
FOREVER = 1 << 60


def host_of(url: Column) -> Column:
    """The lower-case host, '' if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"\.$", "")


def url_keys(url: Column) -> Column:
    """The host, its parent domains, and the host with each prefix of the path's segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(
        F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def validity_intervals(changes: DataFrame, span: int = SPAN_SECONDS) -> DataFrame:
    """``(list, key, verdict, valid_from, valid_to)`` from changes ``(list, key, action, verdict, time)``.

    Times are long (epoch seconds); ``valid_to`` is exclusive, ``FOREVER`` for
    entries still active.
    """
    named = (changes.select(F.col("list").cast("string"), F.col("key").cast("string"), "action",
                            F.col("verdict").cast("string"), F.col("time").cast("long"))
             .dropna(subset=["list", "key", "action", "time"]).where(F.col("action").isin("add", "remove"))
             .withColumn("key", F.concat(F.lower(F.substring_index("key", "/", 1)),
                                         F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))))
    # one change for each time: "remove" sorts after "add"
    one = (named.groupBy("list", "key", "time").agg(F.max(F.struct("action", "verdict")).alias("c"))
           .select("list", "key", "time", "c.action", "c.verdict")
           .withColumn("span", F.floor(F.col("time") / span)))
    inside = Window.partitionBy("list", "key", "span").orderBy("time")
    across = Window.partitionBy("list", "key").orderBy("span")
    spans = (one.groupBy("list", "key", "span").agg(F.min("time").alias("first"))
             .withColumn("next_span", F.lead("first").over(across)).drop("first"))
    return (one.withColumn("next", F.lead("time").over(inside))
            .join(spans, ["list", "key", "span"])
            .where("action = 'add'")
            .select("list", "key", "verdict", F.col("time").alias("valid_from"),
                    F.coalesce("next", "next_span", F.lit(FOREVER)).alias("valid_to")))


def judge(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched_at",
          span: int = SPAN_SECONDS) -> DataFrame:
    """``captures`` with ``verdict``, ``matched_key`` and ``lists`` (sorted names of all active matches).

    ``time_col`` is epoch seconds. Without a match, verdict and key are null and
    ``lists`` is empty.
    """
    kept = [c for c in captures.columns if c not in ("verdict", "matched_key", "lists")]
    asked = (captures.select(F.col(url_col).alias("__u"), F.col(time_col).cast("long").alias("__t"))
             .dropna().distinct())
    bounds = asked.agg(F.min("__t").alias("lo"), F.max("__t").alias("hi")).first()
    lo, hi = (bounds["lo"], bounds["hi"]) if bounds["lo"] is not None else (0, 0)
    active = (validity_intervals(changes, span)
              .where((F.col("valid_from") <= hi) & (F.col("valid_to") > lo))
              .withColumn("span", F.explode(F.sequence(
                  F.floor(F.greatest("valid_from", F.lit(lo)) / span),
                  F.floor(F.least(F.col("valid_to") - 1, F.lit(hi)) / span)))))
    points = (asked.withColumn("key", F.explode(url_keys(F.col("__u"))))
              .withColumn("span", F.floor(F.col("__t") / span)))
    hits = points.join(active, ["key", "span"]).where("__t >= valid_from and __t < valid_to")
    rank = F.struct(F.length("key").alias("n"), (F.col("verdict") == "block").alias("b"), "key", "verdict")
    judged = hits.groupBy("__u", "__t").agg(F.max(rank).alias("best"), F.sort_array(F.collect_set("list")).alias("lists"))
    judged = judged.select("__u", "__t", F.col("best.verdict").alias("verdict"),
                           F.col("best.key").alias("matched_key"), "lists")
    out = captures.select(*kept)
    return (out.join(judged, (out[url_col] == judged["__u"]) & (out[time_col].cast("long") == judged["__t"]), "left")
            .select(*[out[c] for c in kept], "verdict", "matched_key",
                    F.coalesce("lists", F.array().cast("array<string>")).alias("lists")))
