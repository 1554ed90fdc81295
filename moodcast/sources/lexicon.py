"""The sentiment lexicon as an input table.

The reference downloads a valence lexicon at run time; here it is a table
(word, valence). ``read_valence_file`` reads the published tab-separated
format of that lexicon: token, mean valence, standard deviation, raw ratings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE_SCHEMA = "word string, valence double, sd double, ratings string"


def read_valence_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, valence) from a tab-separated lexicon file. Quoting is off
    (tokens such as emoticons contain quote characters); malformed lines are
    dropped; words are lower-cased like the tokens they are matched with."""
    raw = (spark.read.option("sep", "\t").option("quote", "\u0000").option("mode", "DROPMALFORMED")
           .schema(_FILE_SCHEMA).csv(path))
    return (raw.filter(F.col("word").isNotNull() & F.col("valence").isNotNull())
            .select(F.lower("word").alias("word"), "valence"))
