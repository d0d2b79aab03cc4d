"""The derived tables as one store: commits of all tables at once, versions of rows that change, merges, clean-up.

A commit writes each table's rows into a folder of its own, ``{table}/attempt=...``, and a marker last. The marker
names the folder, so that what a crash leaves behind is never read, and nothing is ever overwritten: a reader keeps
the folders that it began with. Every row has the ``version`` of its commit.

- *History* tables (events, transfers, ...) only grow. Rows of a range of ledgers can be *replaced*: the commit that
  has the new rows also has a mark that takes the older ones of that range and table out.
- *Keyed* tables (gaps, walks, cursors) have a row for each key, the one of the greatest version.

History folders are parted by bucket of ledgers, so that reads and merges open the buckets they need. There is one
writer at a time, as with any single stream; readers need no care.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .landing import bucket_of, parquet, read_ledgers

MARKER = "version bigint, stream string, batch_id bigint, attempt string, replaces array<string>, n_rows map<string,bigint>, counters map<string,bigint>"
#: Marks that take rows of older versions out: of one table, or of all where it is null.
REPLACED = "table string, network string, first bigint, last bigint"
LEDGER = ["network", "ledger_sequence"]
#: Tables of a commit that are written at a time.
WRITERS = 4


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``."""
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return found.select(*[F.col(c) if c in key else F.col(f"_r.`{c}`").alias(c) for c in rows.columns])


@dataclass
class Store:
    """``history`` has the schemas of tables by ledger, ``keyed`` those of tables by key, with their keys.

    ``folds`` reduce a history table's rows when they are merged; such a table is parted by its fold's slots in
    place of ledgers, and marks do not reach it.
    """

    spark: SparkSession
    root: str
    history: dict[str, str]
    keyed: dict[str, tuple[str, list[str]]]
    folds: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = field(default_factory=dict)
    _pinned: list[Row] | None = None

    # the log

    @contextmanager
    def as_of_now(self) -> Iterator[Store]:
        """The store as it is now, for several reads that belong together."""
        self._pinned = self._marks()
        try:
            yield self
        finally:
            self._pinned = None

    @contextmanager
    def pinned(self) -> Iterator[Store]:
        """The store as it is now, for the reads of the writing job up to its commit; staged rows go at the end."""
        with self.as_of_now():
            try:
                yield self
            finally:
                self._delete(f"{self.root}/_work")

    def _marks(self) -> list[Row]:
        return self.markers().collect() if self._pinned is None else self._pinned  # a row a commit

    def markers(self) -> DataFrame:
        return parquet(self.spark, f"{self.root}/_commits", MARKER)

    def log(self) -> list[Row]:
        """Commits that count, in order: one attempt of each batch, without those that a merge took over."""
        rows = self._marks()
        gone = {a for r in rows for a in r["replaces"]}
        first: dict[tuple, Row] = {}
        for r in sorted(rows, key=lambda r: (r["version"], r["attempt"])):
            first.setdefault((r["stream"], r["batch_id"]), r)
        return [r for r in first.values() if r["attempt"] not in gone]

    def is_committed(self, stream: str, batch_id: int) -> bool:
        return any((r["stream"], r["batch_id"]) == (stream, batch_id) for r in self._marks())

    # reading

    def _raw(self, table: str, schema: str, log: list[Row]) -> DataFrame:
        """All rows of the log's commits, with version and bucket."""
        paths = [f"{self.root}/{table}/attempt={r['attempt']}" for r in log if (r["n_rows"] or {}).get(table)]
        full = f"{schema}, version bigint" + (", bucket bigint" if table in self.history else "")
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*paths).drop("attempt")

    def _counting(self, table: str, rows: DataFrame, log: list[Row]) -> DataFrame:
        """Rows without those that a later commit replaced. Without marks there is nothing to join."""
        if table in self.folds or not any((r["n_rows"] or {}).get("_replaced") for r in log):
            return rows
        marks = self._raw("_replaced", REPLACED, log).where(F.col("table").isNull() | (F.col("table") == table))
        spans = F.explode(F.sequence(bucket_of("first"), bucket_of("last")))
        marks = marks.select("network", spans.alias("bucket"), "first", "last", F.col("version").alias("_by"))
        hit = (F.col("r.ledger_sequence").between(F.col("m.first"), F.col("m.last"))) & (F.col("r.version") < F.col("m._by"))
        same = (F.col("r.network") == F.col("m.network")) & (F.col("r.bucket") == F.col("m.bucket"))
        return rows.alias("r").join(marks.alias("m"), same & hit, "left_anti")

    def rows(self, table: str, log: list[Row] | None = None) -> DataFrame:
        """Rows of a history table that count, with version and bucket."""
        log = self.log() if log is None else log
        return self._counting(table, self._raw(table, self.history[table], log), log)

    def read(self, table: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """A table as it is now; of a history table the ledgers from ``first`` to ``last``, if given, from their buckets."""
        if table in self.keyed:
            schema, key = self.keyed[table]
            return latest(self._raw(table, schema, self.log()), key, ["version"]).drop("version")
        rows = self.rows(table)
        if first is not None:
            rows = read_ledgers(rows, first, last)
        return rows.drop("version", "bucket")

    # writing

    def staged(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written to the store's work folder and read back, to be used several times in a :meth:`pinned` job."""
        path = f"{self.root}/_work/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _place(self, table: str) -> F.Column:
        return F.expr(self.folds[table][1]) if table in self.folds else bucket_of()

    def _write(self, table: str, rows: DataFrame, attempt: str) -> Observation:
        seen = Observation()
        path = f"{self.root}/{table}/attempt={attempt}"
        if table in self.history:
            order = [c for c in ("ledger_sequence", "id", "transfer_id") if c in rows.columns]
            rows = rows.withColumn("bucket", self._place(table).cast("long")).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("bucket").parquet(path)
        else:
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return seen

    def commit(
        self, tables: dict[str, DataFrame], stream: str = "manual", batch_id: int | None = None, replaced: DataFrame | None = None,
        counters: Callable[[], dict[str, int]] = dict, replaces: tuple[str, ...] = (), versioned: bool = False,
    ) -> int:
        """Write all tables of a batch and the marker last; the version that they have from then on.

        ``replaced`` (table, network, first, last) takes older rows out. ``counters`` is asked once the tables are
        written, so that it can give what was observed on the way. Rows that are ``versioned`` keep their version.
        """
        version = max((r["version"] for r in self._marks()), default=0) + 1
        batch_id = version if batch_id is None else batch_id
        attempt = f"{version:012d}-{stream}-{batch_id}-{uuid.uuid4().hex}"
        every = {**tables, **({} if replaced is None else {"_replaced": replaced})}
        # tables are written side by side: most are small, and none needs another
        with ThreadPoolExecutor(WRITERS) as pool:
            write = inheritable_thread_target(self.spark)(lambda table, rows: self._write(table, rows if versioned else rows.withColumn("version", F.lit(version).cast("long")), attempt))
            begun = {table: pool.submit(write, table, rows) for table, rows in every.items()}
            seen = {table: done.result() for table, done in begun.items()}
        n_rows = {table: int(found.get.get("n", 0)) for table, found in seen.items()}
        mark = (version, stream, batch_id, attempt, list(replaces), n_rows, {k: int(v or 0) for k, v in counters().items()})
        self.spark.createDataFrame([mark], MARKER).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")
        self._pinned = None
        return version

    # upkeep

    def compact(self, fanout: int = 8) -> list[str]:
        """Merge commits of like size, the smallest first, wherever ``fanout`` of them have come together; the names of those merged.

        Sizes are classed by powers of ``fanout``, so that a row is copied once a class and there are few commits of
        each: the work of a merge follows what it merges, not the store. Replaced rows and older rows of a key are
        left out of what is merged. Readers keep what they have; :meth:`vacuum` removes it later.
        """
        merged: list[str] = []
        while True:
            log = self.log()
            classes: dict[int, list[Row]] = defaultdict(list)
            for r in log:
                classes[int(math.log(max(sum((r["n_rows"] or {}).values()), 1), fanout))].append(r)
            full = sorted(k for k, own in classes.items() if len(own) >= fanout)
            if not full:
                return merged
            self._merge(classes[full[0]], log)
            merged += [r["attempt"] for r in classes[full[0]]]

    def _merge(self, some: list[Row], log: list[Row]) -> None:
        tables = {}
        for table, schema in self.history.items():
            rows = self._counting(table, self._raw(table, schema, some), log).drop("bucket")
            tables[table] = self.folds[table][0](rows) if table in self.folds else rows
        for table, (schema, key) in self.keyed.items():
            tables[table] = latest(self._raw(table, schema, some), key, ["version"])
        # marks are still needed for the rows of commits that are not merged here
        marks = self._raw("_replaced", REPLACED, some)
        present = {t for r in some for t, n in (r["n_rows"] or {}).items() if n}
        sums: dict[str, int] = defaultdict(int)
        for r in some:
            for k, v in (r["counters"] or {}).items():
                sums[k] += v
        self.commit({t: rows for t, rows in tables.items() if t in present}, "compaction", None, marks if "_replaced" in present else None, lambda: sums, tuple(r["attempt"] for r in some), True)

    def vacuum(self, seconds: float = 86_400) -> list[str]:
        """Remove folders that no commit in force names and that have not been touched for ``seconds``: merged ones, and what crashes left."""
        used = {r["attempt"] for r in self.log()}
        gone = []
        conf = self.spark._jsc.hadoopConfiguration()
        for table in [*self.history, *self.keyed, "_replaced"]:
            top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            fs = top.getFileSystem(conf)
            for found in fs.listStatus(top) if fs.exists(top) else []:
                attempt = found.getPath().getName().removeprefix("attempt=")
                if attempt not in used and found.getModificationTime() / 1000 <= time.time() - seconds:
                    fs.delete(found.getPath(), True)
                    gone.append(f"{table}/{attempt}")
        return gone

    def counters(self) -> dict[str, int]:
        """Sums of what commits counted."""
        sums: dict[str, int] = defaultdict(int)
        for r in self.log():
            for k, v in (r["counters"] or {}).items():
                sums[k] += v
        return dict(sums)
