"""Plan shape: filters reach the scan, no Python UDF, no Cartesian product,
the lexicon is broadcast, top-N uses a group limit, dt prunes partitions."""

import pytest

import __spark_entry__ as E
from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.composite import composite_sentiment
from moodcast.sources import fixtures as FX
from moodcast.sources.store import with_dt, write_table
from moodcast.sources.tables import conform, load, read_table
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in E.queries() if q.startswith("q_")))
def test_no_python_udf_or_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin", "PythonUDF"):
        assert bad not in p, f"{name}: {bad}"


def test_filters_and_projection_reach_the_scan(spark):
    p = plan(E.queries()["q_recent_posts"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(value)" in p or "PushedFilters: [IsNotNull(" in p
    text = E.queries()["q_text_sentiment"](spark, SF_SMALL)
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan(text) or \
        "ReadSchema: struct<doc_id:bigint,text:string>" in plan(text)


def test_lexicon_join_is_broadcast(spark):
    p = plan(E.queries()["q_text_sentiment"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_rows_without_hits_stay_outside_the_lexicon_join(spark):
    """Only tokens meet the lexicon, in an inner join; the rows that keep a document join at a union above."""
    p = E.queries()["q_text_sentiment"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in p.splitlines() if "Join " in line]
    assert len(joins) == 1 and "Join Inner" in joins[0]
    union, join = p.index("Union"), p.index("Join Inner")
    assert union < join
    assert "explode(" in p[join:]


def test_planning_a_text_query_runs_no_job(spark):
    lex = spark.range(3).selectExpr("cast(assert_true(id < 0) as string) word", "1.0D valence")
    docs = spark.range(2).selectExpr("cast(id as string) id", "cast(assert_true(id < 0) as string) text")
    from moodcast.operators import text as T
    plan(T.text_sentiment(docs, "id", "text", lex))


def test_newest_n_uses_group_limit(spark):
    df = E.queries()["q_newest_n"](spark, SF_SMALL)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_dt_partition_pruning_on_stored_tables(spark, tmp_root):
    ev = load(spark, SF_SMALL, "events")
    posts = with_dt(FX.submissions(ev), "created")
    write_table(conform(posts, S.SUBMISSIONS), f"{tmp_root}/p")
    dt = posts.select("id", "dt")
    write_table(FX.submission_scores(ev).join(dt, "id"), f"{tmp_root}/s")
    write_table(FX.submission_sentiments(ev).join(dt, "id"), f"{tmp_root}/t")
    c = composite_sentiment(read_table(spark, f"{tmp_root}/p", S.SUBMISSIONS),
                            read_table(spark, f"{tmp_root}/s", S.SUBMISSION_SCORES),
                            read_table(spark, f"{tmp_root}/t", S.SUBMISSION_SENTIMENTS),
                            FX.AS_OF, 5)
    c.collect()
    p = c._jdf.queryExecution().executedPlan().toString()
    # all three scans prune by date, not only the posts table
    assert p.count("PartitionFilters: [isnotnull(dt") >= 3, p


def test_aggregations_are_two_phase(spark):
    p = plan(E.queries()["q_hourly_sums"](spark, SF_SMALL))
    assert "partial_sum" in p


def test_retention_days_param_changes_result(spark):
    q = E.queries()["q_composite"](spark, SF_SMALL).count()
    assert q > 0 and P.RETENTION_DAYS == 90


def test_ingest_hashes_first(spark):
    """The anti join on hashes moves no text, and counting updates splits no text into tokens."""
    from moodcast.operators.ingest import sentiment_todo
    from moodcast.sources.fixtures import Fixture

    fx = Fixture(spark, SF_SMALL)
    keys = sentiment_todo(fx.stored_sentiments(), fx.poll_batch())[1]
    assert keys.columns == ["id", "hash_check", "polled_at"]
    for line in plan(keys).splitlines():
        if "Exchange" in line or "SortAggregate" in line:
            assert "selftext" not in line
    assert "regexp_extract_all" not in plan(E.queries()["q_ingest_counts"](spark, SF_SMALL))


def test_newest_has_two_levels(spark):
    assert plan(E.queries()["q_newest_n"](spark, SF_SMALL)).count("WindowGroupLimit") >= 3


def test_posts_to_score_are_dealt_evenly(spark):
    """Their text is shuffled into a fixed number of tasks, which Spark does not merge by bytes."""
    from moodcast.operators import text as T
    df = E.queries()["q_sentiment_incremental"](spark, SF_SMALL)
    dealt = [x for x in plan(df).splitlines() if "REPARTITION_BY_NUM" in x]
    assert dealt and all(f", {T.TASKS_A_CORE * spark.sparkContext.defaultParallelism})" in x for x in dealt)
