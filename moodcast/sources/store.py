"""Writing stored tables: partitioned Parquet, touched-partition merges, publish.

Design (no lakehouse jar in the target image; see README):
* Tables are partitioned by ``dt`` (UTC date of the post, or of the bucket).
  A post's ``created`` never changes, so an upsert touches few partitions.
* A merge reads only the touched partitions, merges them in Spark, writes the
  result to a staging table under the shared checkpoint folder (this cuts the
  lineage to the files about to be replaced -- overwriting a path that the
  same plan reads would destroy it), then overwrites just those partitions
  with dynamic partition overwrite. Re-running a batch is idempotent.
* With Delta or Iceberg on the classpath the same merge is one
  ``DataFrame.mergeInto``; the operators only produce the merged rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodcast import params as P
from moodcast.session import scratch_path
from moodcast.sources.tables import read_table

PART = "dt"


def date_of(epoch_col: str):
    """Partition value: the UTC date of an epoch column."""
    return F.date_from_unix_date(F.floor(F.col(epoch_col) / F.lit(float(P.DAY))).cast("int"))


def with_dt(df: DataFrame, epoch_col: str) -> DataFrame:
    return df.withColumn(PART, date_of(epoch_col))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = True) -> None:
    """Write partitioned by ``dt`` when present. ``dynamic`` overwrite replaces
    only the partitions present in ``df``; staging writes pass ``False`` so a
    reused staging folder is replaced whole."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    if PART in df.columns:
        w = w.partitionBy(PART)
    w.parquet(path)


POST_TABLES = ("submissions", "submission_scores", "submission_sentiments")


@dataclass(frozen=True)
class TableStore:
    """Where the stored tables live.

    Default: path-based Parquet under ``root``, partitioned by ``dt``. With
    ``buckets``, the three post tables become catalog tables
    (``<prefix>_<name>``, data at the same paths), partitioned by ``dt`` and
    bucketed and sorted by ``id`` into the same number of buckets: the
    composite's two joins then read co-located buckets and shuffle nothing.
    Pick ``buckets`` so one bucket of one date holds roughly 100-500 MB.
    """

    root: str
    buckets: int | None = None
    prefix: str = "moodcast"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bucketed(self, name: str) -> bool:
        return bool(self.buckets) and name in POST_TABLES

    def table_name(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def exists(self, spark: SparkSession, name: str) -> bool:
        if self.bucketed(name):
            return spark.catalog.tableExists(self.table_name(name))
        return table_exists(spark, self.path(name))

    def read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        if self.bucketed(name):
            t = spark.table(self.table_name(name))
            return t.select(*[c for c in schema.fieldNames() if c in t.columns], PART)
        return read_table(spark, self.path(name), schema)

    def create(self, df: DataFrame, name: str) -> None:
        if self.bucketed(name):
            (df.write.mode("overwrite").format("parquet").partitionBy(PART)
             .bucketBy(self.buckets, "id").sortBy("id").option("path", self.path(name))
             .saveAsTable(self.table_name(name)))
        else:
            write_table(df, self.path(name))

    def replace_partitions(self, df: DataFrame, name: str) -> None:
        """Overwrite exactly the ``dt`` partitions present in ``df``."""
        if self.bucketed(name):
            cols = df.sparkSession.table(self.table_name(name)).columns
            (df.select(*cols).write.option("partitionOverwriteMode", "dynamic")
             .insertInto(self.table_name(name), overwrite=True))
        else:
            write_table(df, self.path(name))

    def join_on(self) -> list[str] | None:
        """Join keys for the post tables: ``[id]`` when bucketed (a post's
        ``dt`` is fixed, and the bucket layout is on ``id``), else automatic."""
        return ["id"] if self.buckets else None


def as_store(root) -> TableStore:
    return root if isinstance(root, TableStore) else TableStore(str(root))


def touched_dates(updates: DataFrame) -> list:
    """The distinct dates of a batch: one value for each calendar day in it, None for rows without."""
    return [r[0] for r in updates.select(PART).distinct().collect()]


def merge_into(spark: SparkSession, store: TableStore, name: str, schema: T.StructType,
               updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
               tag: str, dates: list | None = None) -> None:
    """Apply ``merge(stored_touched, updates)`` to the partitions ``updates`` touch.

    ``updates`` must carry ``dt``. The list of touched dates (``dates``, if the
    caller has it) is the only thing collected to the driver; it is bounded by
    the calendar span of a batch. The partition of rows without a date is read
    and replaced like any other.

    The merged rows are staged in the shared folder first, so the overwrite
    never reads the files it replaces. The stage belongs to this store, table
    and ``tag``: when a run dies while partitions are replaced, its retry
    with the same tag finds the complete stage and only repeats the overwrite. It
    is removed once the overwrite has committed.
    """
    path = scratch_path(spark, "merge", hashlib.md5(
        f"{store.root}|{store.prefix}|{name}|{tag}".encode()).hexdigest())
    if not store.exists(spark, name):
        empty = spark.createDataFrame([], T.StructType(list(schema.fields) +
                                                       [T.StructField(PART, T.DateType())]))
        store.create(_staged(spark, merge(empty, updates), path), name)
    else:
        stored = store.read(spark, name, schema)
        if PART in stored.columns:
            dates = touched_dates(updates) if dates is None else dates
            touched = F.col(PART).isin([d for d in dates if d is not None])
            stored = stored.filter(touched | F.col(PART).isNull() if None in dates else touched)
        store.replace_partitions(_staged(spark, merge(stored, updates), path), name)
    remove(spark, path)


def _staged(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    if not table_exists(spark, f"{path}/_SUCCESS"):
        write_table(df, path, dynamic=False)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish_snapshot(spark: SparkSession, tables, dest_root: str, version: str) -> dict[str, str]:
    """SNK-7: copy every table, as read now, to ``dest_root/<version>/<name>``
    and point ``dest_root/_current`` at that version. Readers resolve the
    pointer, so the serving copy is replaced whole, never half written.

    ``tables`` maps name -> (path, schema), or is ``(TableStore, {name: schema})``
    to publish from a store (bucketed catalog tables included).
    """
    if isinstance(tables, tuple):
        store, schemas = tables
        sources = {n: store.read(spark, n, sch) for n, sch in schemas.items()}
    else:
        sources = {n: read_table(spark, path, sch) for n, (path, sch) in tables.items()}
    if table_exists(spark, f"{dest_root}/{version}"):
        raise ValueError(f"version {version} is published already")
    out = {}
    for name, df in sources.items():
        dst = f"{dest_root}/{version}/{name}"
        write_table(df, dst, mode="errorifexists", dynamic=False)
        out[name] = dst
    _point(spark, f"{dest_root}/_current", version)
    return out


def _point(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and rename it over ``path``, so that a reader always finds a whole one."""
    jvm, fresh = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    fs, p = _fs(spark, fresh)
    stream = fs.create(p)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(p, _fs(spark, path)[1], options)


def current_snapshot(spark: SparkSession, dest_root: str) -> str:
    fs, p = _fs(spark, f"{dest_root}/_current")
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stage(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a staging table of its own in the shared folder and read it back:
    cuts lineage (the plan no longer reads its sources) and survives executor
    loss, unlike a cache or a local checkpoint. ``unstage`` removes it."""
    path = scratch_path(spark, "stage", f"{tag}-{uuid.uuid4().hex}")
    write_table(df, path, dynamic=False)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, tag_path: DataFrame) -> None:
    """Remove a table made by ``stage`` that nothing reads any more."""
    for f in tag_path.inputFiles()[:1]:
        root = f.split("/stage/")[0] + "/stage/" + f.split("/stage/")[1].split("/")[0]
        remove(spark, root)
