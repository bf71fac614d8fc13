"""The archive of old dates: compressed copies with a record of what they hold.

Files are written first and the record of dates and rows last, as one version (see ``streaming.store``): a run that dies
half-way has archived nothing, and the next one repeats it. Rows that come for a date after it was archived are added by the
next run; rows that are there already are not.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.streaming.store import LiveStore

TABLE = "events"
# what tells two lines of the log apart, as far as a table has it
_IDENTITY = ["timestamp", "session_id", "file_name", "seq", "type", "request_id", "provider"]


def _store(spark: SparkSession, out: str) -> LiveStore:
    return LiveStore(spark, out, fan=1 << 20)  # folders stay as written, by date


def _dated(events: DataFrame) -> DataFrame:
    return events if "date" in events.columns else events.withColumn("date", F.to_date("timestamp"))


def _known(store: LiveStore) -> dict[str, int]:
    return store.current()["info"].get("rows", {})


def _not_in(rows: DataFrame, archived: DataFrame) -> DataFrame:
    names = [c for c in _IDENTITY if c in rows.columns and c in archived.columns]
    there = archived.select("date", *names).toDF("__date", *[f"__{c}" for c in names])
    same = [F.col("date") == F.col("__date"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]]
    return rows.join(there, reduce(and_, same), "left_anti")


def _missing(dated: DataFrame, store: LiveStore) -> DataFrame:
    """Rows that the archive does not have. Dates that it does not know need no comparison."""
    known = _known(store)
    if not known:
        return dated
    is_known = F.col("date").isin([dt.date.fromisoformat(d) for d in known])
    return dated.filter(~is_known).unionByName(_not_in(dated.filter(is_known), store.read(TABLE).filter(is_known)))


def archive_events(events: DataFrame, out: str, as_of: dt.datetime, days: int = 7) -> dict[str, int]:
    """Add a zstd copy of dates that ended more than ``days`` days before ``as_of``; gives the rows added by date.

    Rows of these dates that the archive has already are left out, so the job can be repeated.
    """
    spark = events.sparkSession
    store = _store(spark, out)
    store.vacuum()
    cutoff = (as_of - dt.timedelta(days=days)).date()
    old = _missing(_dated(events).filter(F.col("date") < F.lit(cutoff)), store)
    version = store.batch()
    added = version.add(TABLE, old.hint("rebalance", "date"), partition_by=["date"], compression="zstd")
    counts = {str(r.date): r["count"] for r in added.groupBy("date").count().collect()}  # a row per day
    if counts:
        known = version.info.get("rows", {})
        version.info["rows"] = known | {d: n + known.get(d, 0) for d, n in counts.items()}
        version.commit()
    return counts


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """All archived events, pruned by ``date``."""
    rows = _store(spark, out).read(TABLE)
    if rows is None:
        raise FileNotFoundError(f"nothing archived below {out}")
    return rows


def with_archive(events: DataFrame, out: str) -> DataFrame:
    """Live events and archived ones together, none twice: live copies of archived rows are left out."""
    store = _store(events.sparkSession, out)
    archived = store.read(TABLE)
    dated = _dated(events)
    return dated if archived is None else _missing(dated, store).unionByName(archived)


def archived_dates(spark: SparkSession, out: str) -> DataFrame:
    """``date, rows, bytes`` by date, from the record and the sizes of the files it names. No file is read."""
    store = _store(spark, out)
    recorded = [(dt.date.fromisoformat(d), n) for d, n in _known(store).items()]
    rows = spark.createDataFrame(recorded, "date date, rows bigint")
    folders = [f"{out}/{p}" for p in store.folders(TABLE)]
    if not folders:
        return rows.withColumn("bytes", F.lit(0).cast("bigint"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folders)
    named = files.select(F.regexp_extract("path", r"/date=(\d{4}-\d\d-\d\d)/", 1).cast("date").alias("date"), "length")
    return rows.join(named.groupBy("date").agg(F.sum("length").alias("bytes")), "date")
