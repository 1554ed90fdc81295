"""Registered queries over the score history: polls that arrive out of order (SNK-4, STR-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast.operators.history import history_of, latest_scores, splice
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.registry import register
from moodcast.schemas import SCORE_METRICS

_METRICS = ", ".join(SCORE_METRICS)
# all polls at once, in order of their time
_RUNS = [
    ("points", f"""
select id, "timestamp" t, max(row({_METRICS})) m
from (select * from scores_old union all select * from scores_new) x group by id, "timestamp" """),
    ("marked", """
select *, case when lag(m) over w is not distinct from m and row_number() over w > 1 then 0 else 1 end begins
from points window w as (partition by id order by t)"""),
    ("runs", """
select id, min(t) "timestamp", max(t) "until", count(*) n_polls, first(m) m
from (select *, sum(begins) over (partition by id order by t) run from marked) y group by id, run"""),
]
_FIELDS = ", ".join(f"m[{k + 1}] {c}" for k, c in enumerate(SCORE_METRICS))


def _spliced(fx) -> DataFrame:
    """The stored rows, then the later half of the polls, then the earlier half, which is late."""
    polls = fx.scores_new().select("id", "timestamp", *SCORE_METRICS)
    stored = fx.scores_old().select("id", "timestamp", *SCORE_METRICS)
    late = F.floor(F.col("timestamp") / 1200) % 2 == 0
    ahead = splice(history_of(stored), polls.where(~late))
    return splice(ahead, polls.where(late))


@register("q_score_history", with_fixtures(
    f'select id, "timestamp", "until", n_polls, {_FIELDS} from runs', ["scores_old", "scores_new"], _RUNS))
def q_score_history(fx):
    """Runs of equal metrics after late polls."""
    return _spliced(fx).select("id", "timestamp", "until", F.size("polls").cast("long").alias("n_polls"), *SCORE_METRICS)


@register("q_scores_late", with_fixtures(
    f'select id, "timestamp", {_FIELDS} from runs qualify row_number() over (partition by id order by "timestamp" desc) = 1',
    ["scores_old", "scores_new"], _RUNS))
def q_scores_late(fx):
    """Score rows after late polls: none of them goes back in time."""
    return latest_scores(_spliced(fx))
