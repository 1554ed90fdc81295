"""Stored tables: touched-partition merges, the analysis and ingest jobs, publish."""

import os

import pytest
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.buckets import bucket_sums, moving_average
from moodcast.operators.composite import composite_sentiment
from moodcast.plans.analysis import run_analysis
from moodcast.plans.ingest_job import run_ingest
from moodcast.sources import fixtures as FX
from moodcast.sources.store import current_snapshot, publish_snapshot, with_dt, write_table
from moodcast.sources.tables import conform, load, read_table
from tests.conftest import SF_SMALL, rows


def _seed(spark, root):
    ev = load(spark, SF_SMALL, "events")
    posts = with_dt(FX.submissions(ev), "created")
    write_table(conform(posts, S.SUBMISSIONS), f"{root}/submissions")
    dt = posts.select("id", "dt")
    write_table(FX.submission_scores(ev).join(dt, "id"), f"{root}/submission_scores")
    write_table(FX.submission_sentiments(ev).join(dt, "id"), f"{root}/submission_sentiments")
    return ev


def test_analysis_job_writes_partitioned_results(spark, tmp_root):
    ev = _seed(spark, tmp_root)
    p = P.AnalysisParams(as_of=FX.AS_OF, retention_days=FX.RETENTION_DAYS)
    run_analysis(spark, tmp_root, p, "r1")
    hours = read_table(spark, f"{tmp_root}/analyzed_by_created_hours", S.HOURLY)
    days = read_table(spark, f"{tmp_root}/analyzed_by_created_days", S.DAILY)
    assert "dt" in hours.columns and any(n.startswith("dt=") for n in os.listdir(f"{tmp_root}/analyzed_by_created_hours"))
    comp = composite_sentiment(FX.submissions(ev), FX.submission_scores(ev), FX.submission_sentiments(ev),
                               FX.AS_OF, FX.RETENTION_DAYS)
    first = rows(hours.drop("dt"))
    assert first == rows(bucket_sums(comp, P.HOUR))
    assert rows(days.drop("dt")) == rows(moving_average(bucket_sums(comp, P.DAY)))
    # a second run is idempotent
    run_analysis(spark, tmp_root, p, "r2")
    again = read_table(spark, f"{tmp_root}/analyzed_by_created_hours", S.HOURLY)
    assert rows(again.drop("dt")) == first


def test_merge_rewrites_only_touched_partitions(spark, tmp_root):
    _seed(spark, tmp_root)
    run_analysis(spark, tmp_root, P.AnalysisParams(as_of=FX.AS_OF, retention_days=30), "full")
    path = f"{tmp_root}/analyzed_by_created_hours"
    before = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("dt=")}
    run_analysis(spark, tmp_root, P.AnalysisParams(as_of=FX.AS_OF, retention_days=2), "recent")
    after = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("dt=")}
    assert before.keys() == after.keys()
    unchanged = [d for d in before if before[d] == after[d]]
    assert len(unchanged) >= len(before) - 3  # only the last days were rewritten


def test_ingest_job_equals_set_based_ingest(spark, tmp_root):
    docs = load(spark, SF_SMALL, "documents")
    lex = FX.lexicon(spark)
    batch = FX.poll_batch(docs)
    first = run_ingest(spark, tmp_root, batch, lex, FX.AS_OF, "b1")
    assert first.counts["total"] == first.counts["new_posts"] == docs.count()
    from moodcast.operators.ingest import scoring_gate
    assert first.counts["sentiment_updates"] == scoring_gate(FX.raw_posts(docs)).count()
    posts = read_table(spark, f"{tmp_root}/submissions", S.SUBMISSIONS)
    sents = read_table(spark, f"{tmp_root}/submission_sentiments", S.SUBMISSION_SENTIMENTS)
    scores = read_table(spark, f"{tmp_root}/submission_scores", S.SUBMISSION_SCORES)
    assert posts.count() == docs.count()
    assert scores.count() == docs.count()
    assert sents.filter(F.col("sentiment_value").isNotNull()).count() > 0
    snap = rows(sents.drop("dt"))
    again = run_ingest(spark, tmp_root, batch, lex, FX.AS_OF + 60, "b2")  # replay: nothing changes
    assert again.counts["new_posts"] == 0 and again.counts["sentiment_updates"] == 0
    assert again.counts["score_updates"] == 0
    assert rows(read_table(spark, f"{tmp_root}/submission_sentiments", S.SUBMISSION_SENTIMENTS).drop("dt")) == snap
    assert read_table(spark, f"{tmp_root}/submissions", S.SUBMISSIONS).count() == docs.count()


def test_publish_snapshot(spark, tmp_root):
    _seed(spark, tmp_root)
    out = publish_snapshot(spark, {"submissions": (f"{tmp_root}/submissions", S.SUBMISSIONS)},
                           f"{tmp_root}/serve", "v1")
    assert current_snapshot(spark, f"{tmp_root}/serve") == "v1"
    assert spark.read.parquet(out["submissions"]).count() == \
        read_table(spark, f"{tmp_root}/submissions", S.SUBMISSIONS).count()
    from moodcast.sources.store import TableStore
    out2 = publish_snapshot(spark, (TableStore(tmp_root), {"submissions": S.SUBMISSIONS}),
                            f"{tmp_root}/serve", "v2")
    assert current_snapshot(spark, f"{tmp_root}/serve") == "v2"
    assert spark.read.parquet(out2["submissions"]).count() == spark.read.parquet(out["submissions"]).count()


def test_incremental_analysis_equals_full(spark, tmp_root):
    """Ingest a second batch, re-analyse only the touched dates: the result
    tables equal a full recomputation."""
    docs = load(spark, SF_SMALL, "documents")
    lex = FX.lexicon(spark)
    batch = FX.poll_batch(docs)
    first = batch.filter(F.col("created") < 1704067200 + 60 * 600)
    later = batch.withColumn("polled_at", F.col("polled_at") + 3600) \
        .withColumn("score", F.col("score") + 3).filter(F.col("created") >= 1704067200 + 150 * 600)
    p = P.AnalysisParams(as_of=FX.AS_OF, retention_days=40)
    run_ingest(spark, tmp_root, first.unionByName(batch.filter(F.col("created") >= 1704067200 + 60 * 600)),
               lex, FX.AS_OF, "b1")
    run_analysis(spark, tmp_root, p, "full1")
    report = run_ingest(spark, tmp_root, later, lex, FX.AS_OF, "b2")
    touched = report.dates
    assert report.counts["total"] == later.count() and report.counts["new_posts"] == 0
    assert report.counts["score_updates"] == later.count()
    assert len(touched) == 1, touched  # only the second day is recomputed
    run_analysis(spark, tmp_root, p, "incr", dates=touched)
    inc_h = rows(read_table(spark, f"{tmp_root}/analyzed_by_created_hours", S.HOURLY).drop("dt"))
    inc_d = rows(read_table(spark, f"{tmp_root}/analyzed_by_created_days", S.DAILY).drop("dt"))
    posts = read_table(spark, f"{tmp_root}/submissions", S.SUBMISSIONS)
    scores = read_table(spark, f"{tmp_root}/submission_scores", S.SUBMISSION_SCORES)
    sents = read_table(spark, f"{tmp_root}/submission_sentiments", S.SUBMISSION_SENTIMENTS)
    comp = composite_sentiment(posts, scores, sents, FX.AS_OF, 40)
    assert inc_h == rows(bucket_sums(comp, P.HOUR))
    assert inc_d == rows(moving_average(bucket_sums(comp, P.DAY)))


def test_bucketed_store_joins_without_shuffle(spark, tmp_root):
    """The three post tables bucketed by id: ingest + analysis give the same
    tables as the path layout, and the composite joins plan no exchange."""
    import uuid

    from moodcast.sources.store import TableStore
    docs = load(spark, SF_SMALL, "documents")
    lex = FX.lexicon(spark)
    batch = FX.poll_batch(docs)
    p = P.AnalysisParams(as_of=FX.AS_OF, retention_days=40)
    plain = TableStore(f"{tmp_root}/plain")
    bucketed = TableStore(f"{tmp_root}/bucketed", buckets=4, prefix="b" + uuid.uuid4().hex[:8])
    for store in (plain, bucketed):
        run_ingest(spark, store, batch, lex, FX.AS_OF, "b1")
        run_ingest(spark, store, batch.withColumn("score", F.col("score") + 1)
                   .withColumn("polled_at", F.col("polled_at") + 60), lex, FX.AS_OF, "b2")
        run_analysis(spark, store, p, "r1")
    for name, schema in (("submission_scores", S.SUBMISSION_SCORES),
                         ("analyzed_by_created_hours", S.HOURLY), ("analyzed_by_created_days", S.DAILY)):
        assert rows(plain.read(spark, name, schema).drop("dt")) == \
            rows(bucketed.read(spark, name, schema).drop("dt")), name
    comp = composite_sentiment(bucketed.read(spark, "submissions", S.SUBMISSIONS),
                               bucketed.read(spark, "submission_scores", S.SUBMISSION_SCORES),
                               bucketed.read(spark, "submission_sentiments", S.SUBMISSION_SENTIMENTS),
                               FX.AS_OF, 40, join_on=bucketed.join_on())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = comp._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan


def _post(i, created, polled, score):
    return (i, "stocks", "a title long enough", "word " * 30, created, polled, score)


_POST = "id string, subreddit string, title string, selftext string, created long, polled_at long, score int"


def test_rows_without_id_or_time_are_set_aside_and_nothing_is_lost(spark, tmp_root):
    lex = FX.lexicon(spark)
    one = spark.createDataFrame([_post("a", 1704067200, 1, 3), _post("k", None, 1, 3)], _POST)
    two = spark.createDataFrame([_post("b", 1704067300, 2, 3), _post("z", None, 2, 3), _post(None, 1704067300, 2, 3)], _POST)
    assert run_ingest(spark, tmp_root, one, lex, FX.AS_OF, "n1").counts["rejected"] == 1
    report = run_ingest(spark, tmp_root, two, lex, FX.AS_OF, "n2")
    assert report.counts["rejected"] == 2 and report.counts["total"] == 1
    ids = [r["id"] for r in read_table(spark, f"{tmp_root}/submissions", S.SUBMISSIONS).collect()]
    assert sorted(ids) == ["a", "b"]


def test_null_partition_is_merged_not_replaced(spark, tmp_root):
    from moodcast.operators.upsert import upsert_rows
    from moodcast.sources.store import TableStore, merge_into

    store = TableStore(tmp_root)
    for k, i in enumerate("ab"):
        rows_ = with_dt(spark.createDataFrame([(i, None, k)], "id string, created long, score int"), "created")
        merge_into(spark, store, "t", rows_.drop("dt").schema, rows_, lambda s, u: upsert_rows(s, u, ["id"]), f"m{k}")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_root}/t").collect()) == ["a", "b"]


def test_two_stores_with_one_batch_id_and_no_staging_left(spark, tmp_root):
    from moodcast.session import checkpoint_dir

    def left():
        top = checkpoint_dir(spark)
        return {os.path.join(d, n) for k in ("stage", "merge") if os.path.isdir(f"{top}/{k}")
                for d, names, _ in os.walk(f"{top}/{k}") for n in names}

    lex, before = FX.lexicon(spark), left()
    for name in "xy":
        df = spark.createDataFrame([_post(name, 1704067200, 1, 3)], _POST)
        run_ingest(spark, f"{tmp_root}/{name}", df, lex, FX.AS_OF, "same")
    for name in "xy":
        t = read_table(spark, f"{tmp_root}/{name}/submissions", S.SUBMISSIONS)
        assert [r["id"] for r in t.collect()] == [name]
    assert left() == before


def test_retry_after_a_failure_while_partitions_are_replaced(spark, tmp_root, monkeypatch):
    from moodcast.operators.upsert import upsert_rows
    from moodcast.sources.store import TableStore, merge_into

    store = TableStore(tmp_root)
    schema = "id string, created long, score int"

    def merge(rows_, tag):
        df = with_dt(spark.createDataFrame(rows_, schema), "created")
        merge_into(spark, store, "t", df.drop("dt").schema, df, lambda s, u: upsert_rows(s, u, ["id"]), tag)

    merge([("a", 0, 1), ("b", 0, 1)], "r0")
    replace = TableStore.replace_partitions

    def dies(self, df, name):
        import shutil
        shutil.rmtree(f"{tmp_root}/t/dt=1970-01-01")   # half replaced
        raise OSError("lost")

    monkeypatch.setattr(TableStore, "replace_partitions", dies)
    with pytest.raises(OSError):
        merge([("b", 0, 2)], "r1")
    monkeypatch.setattr(TableStore, "replace_partitions", replace)
    merge([("b", 0, 2)], "r1")
    spark.catalog.refreshByPath(f"{tmp_root}/t")
    assert sorted((r["id"], r["score"]) for r in spark.read.parquet(f"{tmp_root}/t").collect()) == [("a", 1), ("b", 2)]


def test_publish_replaces_and_refuses(spark, tmp_root):
    src, dest = f"{tmp_root}/src", f"{tmp_root}/serve"
    schema = S.SUBMISSION_SCORES
    df = spark.createDataFrame([("a", 0, 1.0, 1, 1, 1), ("b", 86400, 1.0, 1, 1, 1)], schema)
    write_table(with_dt(df, "timestamp"), src, dynamic=False)
    publish_snapshot(spark, {"t": (src, schema)}, dest, "v1")
    write_table(with_dt(df.limit(1), "timestamp"), src, dynamic=False)
    out = publish_snapshot(spark, {"t": (src, schema)}, dest, "v2")
    assert current_snapshot(spark, dest) == "v2" and spark.read.parquet(out["t"]).count() == 1
    with pytest.raises(ValueError):
        publish_snapshot(spark, {"t": (src, schema)}, dest, "v2")
    assert current_snapshot(spark, dest) == "v2"


def test_unset_shared_folder_raises_on_a_cluster():
    from types import SimpleNamespace

    from moodcast.session import checkpoint_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None),
                           sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        checkpoint_dir(fake)
