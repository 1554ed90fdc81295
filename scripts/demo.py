"""End to end on stored tables: ingest two poll batches, analyse the touched
dates, then read a day chart, one details page and the freshness alerts.

Usage: python scripts/demo.py [sf_dir]   (default /root/testdata/sf0.01)
Tables go to a fresh folder under the session's spark.checkpoint.dir.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from moodcast import params as P  # noqa: E402
from moodcast import schemas as S  # noqa: E402
from moodcast.operators.details import post_details  # noqa: E402
from moodcast.operators.quality import freshness_stored  # noqa: E402
from moodcast.operators.series import chart_series, day_range  # noqa: E402
from moodcast.plans.analysis import run_analysis  # noqa: E402
from moodcast.plans.ingest_job import run_ingest  # noqa: E402
from moodcast.session import build_session, scratch_path  # noqa: E402
from moodcast.sources import fixtures as FX  # noqa: E402
from moodcast.sources.store import TableStore  # noqa: E402
from moodcast.sources.tables import load  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    store = TableStore(scratch_path(spark, f"demo-{uuid.uuid4().hex[:8]}"))
    docs = load(spark, sf, "documents")
    lexicon = FX.lexicon(spark)
    batch = FX.poll_batch(docs)
    as_of = FX.AS_OF

    first = run_ingest(spark, store, batch, lexicon, as_of, "poll-1")
    print("poll 1:", first.counts)
    run_analysis(spark, store, P.AnalysisParams(as_of=as_of, retention_days=40), "run-1")

    repoll = (batch.filter(F.col("created") >= 1704067200 + 5 * 86400)
              .withColumn("polled_at", F.col("polled_at") + 1200)
              .withColumn("score", F.col("score") + 2))
    second = run_ingest(spark, store, repoll, lexicon, as_of, "poll-2")
    print("poll 2:", second.counts, "touched dates:", len(second.dates))
    run_analysis(spark, store, P.AnalysisParams(as_of=as_of, retention_days=40), "run-2",
                 dates=second.dates)

    days = store.read(spark, "analyzed_by_created_days", S.DAILY)
    hours = store.read(spark, "analyzed_by_created_hours", S.HOURLY)
    start, end = day_range(as_of, "UTC", P.DISPLAY_DAY)
    chart = chart_series(days, start, end, use_sma=True)
    print("day chart series:", chart.select("series").distinct().count(), "points:", chart.count())

    posts = store.read(spark, "submissions", S.SUBMISSIONS)
    busiest = days.orderBy(F.desc("sum_sentiment_score")).first()
    details = post_details(posts, store.read(spark, "submission_scores", S.SUBMISSION_SCORES),
                           store.read(spark, "submission_sentiments", S.SUBMISSION_SENTIMENTS),
                           "day", busiest.subreddit, busiest.timestamp)
    details.select("id", "created", "slug", "score", "sentiment_value", "composite_sentiment",
                   "effect").show(5, truncate=False)
    freshness_stored(posts, days, hours, as_of).show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
