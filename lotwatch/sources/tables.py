"""Tables on plain Parquet: full replace, keyed merge, schema and counts.

A batch is appended as a delta of its own size; nothing is rewritten for it.
Readers take the base as it is for keys that no delta touches and resolve the
rest, so what has to be shuffled grows with the deltas.  Deltas are merged with
each other now and then, and with the base once they have become a large part
of it; the first base is made once batches have become small beside what they
are added to.  One appended log entry makes a folder current: a job that dies before
it leaves nothing visible and can simply run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwatch.operators.versions import last_arrival, union_by_name

LOG = "version bigint, kind string, folder string, source string, batch_id bigint, n_rows bigint"
ARRIVAL, DELETED = "_seq", "_deleted"

# Deltas that are merged into one, and the share of the base at which they are merged with it.
DELTAS = 16
BASE_SHARE = 0.5


class MergedTable:
    """A table with one row per key, kept as a base and deltas.

    ``pick`` chooses the row of each key among old and new ones; by default the
    last to arrive.  It must keep the columns ``_seq`` and ``_deleted``.  Rows
    deleted by :meth:`replace_keys` are deltas that only say so.  One writer at
    a time.
    """

    def __init__(
        self, spark: SparkSession, root: str, key: str | Sequence[str], schema: T.StructType, pick: Callable[[DataFrame], DataFrame] | None = None
    ):
        self.spark, self.root, self.schema = spark, root, schema
        self.keys = [key] if isinstance(key, str) else list(key)
        self.pick = pick or (lambda rows: last_arrival(rows, self.keys, [ARRIVAL], by_hash=True))
        self._stored = T.StructType([*schema.fields, T.StructField(ARRIVAL, T.LongType()), T.StructField(DELETED, T.BooleanType())])

    # reading

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _state(self) -> tuple[int, list, list]:
        """Last version, and the log entries of the base and of the deltas on it; one entry per commit."""
        base, deltas, version = [], [], 0
        for entry in sorted(self._log().collect(), key=lambda r: r["version"]):
            version = entry["version"]
            if entry["kind"] == "base":
                base, deltas = [entry], []
            else:
                deltas = [*(deltas if entry["kind"] == "delta" else []), entry]
        return version, base, deltas

    def has_batch(self, batch_id: int, source: str = "batch") -> bool:
        return not self._log().filter((F.col("batch_id") == batch_id) & (F.col("source") == source)).isEmpty()

    def _folders(self, entries: Sequence) -> DataFrame:
        paths = [e["folder"] for e in entries if e["n_rows"]]
        reader = self.spark.read.schema(self._stored)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self._stored)

    def _same_keys(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.select(*(F.col(k).alias(f"__{k}") for k in self.keys)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return left.join(named, same, how)

    def _resolved(self, touched: DataFrame | None = None) -> DataFrame:
        _, base, deltas = self._state()
        old, new = self._folders(base), self._folders(deltas)
        if deltas and not any(e["n_rows"] for e in base):
            return self.pick(new if touched is None else self._same_keys(new, touched, "left_semi"))
        if touched is not None:
            old, new = self._same_keys(old, touched, "left_semi"), self._same_keys(new, touched, "left_semi")
        if not deltas:
            return old
        changed = self.pick(self._same_keys(old, new, "left_semi").unionByName(new))
        return self._same_keys(old, new, "left_anti").unionByName(changed)

    def _visible(self, rows: DataFrame) -> DataFrame:
        return rows.filter(~F.col(DELETED)).select(*self.schema.fieldNames())

    def read(self) -> DataFrame:
        """The current rows."""
        return self._visible(self._resolved())

    def read_keys(self, touched: DataFrame) -> DataFrame:
        """The current rows of the listed keys."""
        return self._visible(self._resolved(touched))

    def versions(self) -> DataFrame:
        """All rows still stored, superseded ones too: a scan without any shuffle."""
        _, base, deltas = self._state()
        return self._folders([*base, *deltas]).select(*self.schema.fieldNames())

    def count(self) -> int:
        return self.read().count()

    # writing

    def _commit(self, rows: DataFrame, kind: str, source: str = "batch", batch_id: int = -1, version: int | None = None) -> Row:
        """Write rows that carry ``_deleted``; ``_seq`` is the new version where they have none.  Returns the log entry."""
        version = version or self._state()[0] + 1
        folder = f"{self.root}/data/{version}-{uuid.uuid4().hex}"
        if ARRIVAL not in rows.columns:
            rows = rows.withColumn(ARRIVAL, F.lit(version).cast("bigint"))
        written = Observation()
        rows.select(*self._stored.fieldNames()).observe(written, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        n_rows = written.get["n"]
        entry = Row(version=version, kind=kind, folder=folder, source=source, batch_id=batch_id, n_rows=n_rows)
        self.spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").json(f"{self.root}/log")
        return entry

    def _append(self, rows: DataFrame, source: str, batch_id: int) -> int:
        version, base, deltas = self._state()
        entry = self._commit(rows, "delta", source, batch_id, version + 1)
        self._compact_if_due(base, [*deltas, entry])
        return entry["n_rows"]

    def replace(self, rows: DataFrame, batch_id: int = -1, source: str = "batch") -> int:
        """Full replace, also when ``rows`` is computed from the table itself; returns the number of rows."""
        return self._commit(rows.withColumn(DELETED, F.lit(False)), "base", source, batch_id)["n_rows"]

    def merge(self, updates: DataFrame, batch_id: int = -1, source: str = "batch") -> int:
        """Add rows; ``pick`` decides on reading what survives.  Returns the number of rows added."""
        return self._append(updates.withColumn(DELETED, F.lit(False)), source, batch_id)

    def replace_keys(self, touched: DataFrame, rows: DataFrame, batch_id: int = -1, source: str = "batch") -> int:
        """Drop the rows of the touched keys and put ``rows`` in their place."""
        gone = self._same_keys(touched.select(*self.keys).distinct(), rows, "left_anti").withColumn(DELETED, F.lit(True))
        return self._append(union_by_name(rows.withColumn(DELETED, F.lit(False)), gone), source, batch_id)

    def _compact_if_due(self, base: list, deltas: list) -> None:
        """Amortised over batches: a row is rewritten a few times, however many batches follow it."""
        waiting, held = sum(e["n_rows"] for e in deltas), sum(e["n_rows"] for e in base)
        # A table without base rows that still grows by large batches is loading: a base would be rewritten for each few of them.
        loading = not held and deltas[-1]["n_rows"] * DELTAS > waiting
        if len(deltas) > 2 and waiting > BASE_SHARE * held and not loading:
            self.compact()
        elif len(deltas) > DELTAS:
            self._commit(self.pick(self._folders(deltas)), "merged")

    def compact(self) -> int:
        """Merge base and deltas into a new base; returns the number of rows."""
        return self._commit(self._resolved().filter(~F.col(DELETED)), "base")["n_rows"]

    def vacuum(self) -> int:
        """Delete data folders that are current no more; readers that began before must have ended.  Returns how many."""
        _, base, deltas = self._state()
        current = {e["folder"].rsplit("/", 1)[-1] for e in [*base, *deltas]}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in files.listStatus(path) if s.getPath().getName() not in current] if files.exists(path) else []
        for folder in old:
            files.delete(folder, True)
        return len(old)


def table_schema(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of every column; metadata only."""
    return [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]


def describe_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = table_schema(tables)
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return union_by_name(*counts)
