"""moodcast: community-post sentiment analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame built from Spark's built-in expressions, so Catalyst plans the whole
job: filters reach the Parquet scan, aggregations run partial + final, and the
lexicon join is broadcast only behind a size check.
"""

from moodcast.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
