"""Streaming jobs: STR-1 equals batch ingest, STR-2 equals batch on closed
windows, STR-3 drops redelivered poll rows."""

import os

from pyspark.sql import functions as F

from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.buckets import bucket_sums
from moodcast.plans.ingest_job import run_ingest
from moodcast.sources import fixtures as FX
from moodcast.sources.tables import conform, load, read_table
from moodcast.streaming.jobs import dedupe_polls, hourly_stream, start_ingest_stream
from tests.conftest import SF_SMALL, rows


def test_ingest_stream_equals_batch(spark, tmp_root):
    docs = load(spark, SF_SMALL, "documents")
    batch = conform(FX.poll_batch(docs), S.RAW_POSTS)
    lex = FX.lexicon(spark)
    landing = os.path.join(tmp_root, "landing")
    # two landed files: the second re-polls the first half with new metrics
    first = batch.filter(F.col("id").cast("int") % 2 == 0)
    second = batch.withColumn("polled_at", F.col("polled_at") + 600).withColumn("score", F.col("score") + 1)
    first.write.parquet(os.path.join(landing, "f1"))
    second.write.parquet(os.path.join(landing, "f2"))
    q = start_ingest_stream(spark, os.path.join(landing, "*"), os.path.join(tmp_root, "stream"), lex,
                            os.path.join(tmp_root, "ckpt"), as_of_fn=lambda b: FX.AS_OF)
    q.awaitTermination(600)
    stream_scores = read_table(spark, os.path.join(tmp_root, "stream", "submission_scores"), S.SUBMISSION_SCORES)
    run_ingest(spark, os.path.join(tmp_root, "batch"), first.unionByName(second), lex, FX.AS_OF, "one")
    batch_scores = read_table(spark, os.path.join(tmp_root, "batch", "submission_scores"), S.SUBMISSION_SCORES)
    assert rows(stream_scores.drop("dt")) == rows(batch_scores.drop("dt"))
    sp = read_table(spark, os.path.join(tmp_root, "stream", "submissions"), S.SUBMISSIONS)
    bp = read_table(spark, os.path.join(tmp_root, "batch", "submissions"), S.SUBMISSIONS)
    assert rows(sp.drop("dt")) == rows(bp.drop("dt"))


def test_hourly_stream_equals_batch_on_closed_windows(spark, tmp_root):
    rows_in = [("a", "x", 10, 1.5), ("b", "x", 3700, 2.0), ("c", "y", 3800, -1.0), ("d", "x", 30000, 1.0)]
    src = os.path.join(tmp_root, "scored")
    spark.createDataFrame(rows_in, "id string, subreddit string, created long, sentiment_composite double") \
        .write.parquet(src)
    stream = spark.readStream.schema(
        "id string, subreddit string, created long, sentiment_composite double").parquet(src)
    q = (hourly_stream(stream, "1 hour").writeStream.outputMode("append").format("memory")
         .queryName("hourly_out").start())
    q.processAllAvailable()
    q.stop()
    got = rows(spark.sql("select * from hourly_out"))
    batch = spark.createDataFrame(rows_in, "id string, subreddit string, created long, sentiment_composite double")
    want = [r for r in rows(bucket_sums(batch, P.HOUR)) if r[0] + 3600 <= 30000 - 3600]
    assert got == want


def test_dedupe_polls_keeps_changes(spark, tmp_root):
    src = os.path.join(tmp_root, "polls")
    data = [("a", 1, 5), ("a", 1, 5), ("a", 2, 6), ("a", 3, 5)]
    spark.createDataFrame(data, "id string, polled_at long, score int").write.parquet(src)
    s = spark.readStream.schema("id string, polled_at long, score int").parquet(src)
    q = dedupe_polls(s).writeStream.format("memory").queryName("dedup_out").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select * from dedup_out")) == [("a", 1, 5), ("a", 2, 6), ("a", 3, 5)]


def test_stream_with_analysis_equals_batch_analysis(spark, tmp_root):
    from moodcast.operators.composite import composite_sentiment
    from moodcast.operators.buckets import moving_average
    docs = load(spark, SF_SMALL, "documents")
    batch = conform(FX.poll_batch(docs), S.RAW_POSTS)
    landing = os.path.join(tmp_root, "landing")
    batch.filter(F.col("id").cast("int") < 120).write.parquet(os.path.join(landing, "f1"))
    batch.filter(F.col("id").cast("int") >= 80).withColumn("polled_at", F.col("polled_at") + 600) \
        .withColumn("score", F.col("score") * 2).write.parquet(os.path.join(landing, "f2"))
    root = os.path.join(tmp_root, "tables")
    p = P.AnalysisParams(as_of=FX.AS_OF, retention_days=40)
    q = start_ingest_stream(spark, os.path.join(landing, "*"), root, FX.lexicon(spark),
                            os.path.join(tmp_root, "ckpt"), as_of_fn=lambda b: FX.AS_OF,
                            analyse=p)
    q.awaitTermination(900)
    posts = read_table(spark, os.path.join(root, "submissions"), S.SUBMISSIONS)
    scores = read_table(spark, os.path.join(root, "submission_scores"), S.SUBMISSION_SCORES)
    sents = read_table(spark, os.path.join(root, "submission_sentiments"), S.SUBMISSION_SENTIMENTS)
    comp = composite_sentiment(posts, scores, sents, FX.AS_OF, 40)
    hours = read_table(spark, os.path.join(root, "analyzed_by_created_hours"), S.HOURLY)
    days = read_table(spark, os.path.join(root, "analyzed_by_created_days"), S.DAILY)
    assert rows(hours.drop("dt")) == rows(bucket_sums(comp, P.HOUR))
    assert rows(days.drop("dt")) == rows(moving_average(bucket_sums(comp, P.DAY)))


def test_hourly_stream_drops_late_rows(spark, tmp_root):
    schema = "id string, subreddit string, created long, sentiment_composite double"
    src = os.path.join(tmp_root, "scored2")
    spark.createDataFrame([("a", "x", 10 * 3600 + 5, 1.0)], schema).write.parquet(os.path.join(src, "p1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (hourly_stream(stream, "1 hour").writeStream.outputMode("append").format("memory")
         .queryName("late_out").start())
    q.processAllAvailable()
    # 5 hours earlier than the watermark allows: dropped; 20 h later closes hour 10
    spark.createDataFrame([("b", "x", 3 * 3600, 7.0), ("c", "x", 20 * 3600, 1.0)], schema) \
        .write.parquet(os.path.join(src, "p2"))
    q.processAllAvailable()
    spark.createDataFrame([("d", "x", 30 * 3600, 1.0)], schema).write.parquet(os.path.join(src, "p3"))
    q.processAllAvailable()
    q.stop()
    got = rows(spark.sql("select * from late_out"))
    assert (3 * 3600, "x", 7.0) not in got
    assert (10 * 3600, "x", 1.0) in got


def test_ingest_stream_from_json_landing(spark, tmp_root):
    docs = load(spark, SF_SMALL, "documents")
    batch = conform(FX.poll_batch(docs), S.RAW_POSTS).drop("author_fullname", "post_hint", "url")
    landing = os.path.join(tmp_root, "json_landing")
    batch.write.json(os.path.join(landing, "f1"))
    q = start_ingest_stream(spark, os.path.join(landing, "*"), os.path.join(tmp_root, "t"), FX.lexicon(spark),
                            os.path.join(tmp_root, "ck"), as_of_fn=lambda b: FX.AS_OF, fmt="json",
                            max_files=1)
    q.awaitTermination(600)
    posts = read_table(spark, os.path.join(tmp_root, "t", "submissions"), S.SUBMISSIONS)
    assert posts.count() == docs.count()
    assert posts.filter(F.col("author_fullname").isNotNull()).count() == 0
