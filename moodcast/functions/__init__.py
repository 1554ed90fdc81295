"""Column expressions (all JVM-side, codegen-able; no Python UDF)."""

from moodcast.functions.exprs import *  # noqa: F401,F403
