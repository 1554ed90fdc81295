"""Print the physical plan of the hourly job over stored tables.

Writes the three post tables (derived from the sf dir's events) to a fresh
scratch folder, path layout or bucketed (``--buckets N``), disables broadcast
joins as table sizes at scale would, and prints ``explain("formatted")`` of
the composite + hourly sums. Usage:
    python scripts/plan_report.py [sf_dir] [--buckets N]
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from moodcast import params as P  # noqa: E402
from moodcast import schemas as S  # noqa: E402
from moodcast.operators.buckets import bucket_sums  # noqa: E402
from moodcast.operators.composite import composite_sentiment  # noqa: E402
from moodcast.session import build_session, scratch_path  # noqa: E402
from moodcast.sources import fixtures as FX  # noqa: E402
from moodcast.sources.store import TableStore, with_dt  # noqa: E402
from moodcast.sources.tables import conform, load  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    buckets = None
    if "--buckets" in args:
        i = args.index("--buckets")
        buckets = int(args[i + 1])
        del args[i:i + 2]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8,
                          extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    root = scratch_path(spark, f"plan-report-{uuid.uuid4().hex[:8]}")
    store = TableStore(root, buckets=buckets, prefix="plan_" + os.path.basename(root).split("-")[-1])
    ev = load(spark, sf, "events")
    posts = with_dt(FX.submissions(ev), "created")
    dt = posts.select("id", "dt")
    store.create(conform(posts, S.SUBMISSIONS), "submissions")
    store.create(FX.submission_scores(ev).join(dt, "id"), "submission_scores")
    store.create(FX.submission_sentiments(ev).join(dt, "id"), "submission_sentiments")
    comp = composite_sentiment(store.read(spark, "submissions", S.SUBMISSIONS),
                               store.read(spark, "submission_scores", S.SUBMISSION_SCORES),
                               store.read(spark, "submission_sentiments", S.SUBMISSION_SENTIMENTS),
                               FX.AS_OF, FX.RETENTION_DAYS, join_on=store.join_on())
    bucket_sums(comp, P.HOUR).explain("formatted")


if __name__ == "__main__":
    main()
