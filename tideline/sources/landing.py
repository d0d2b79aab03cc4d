"""Landing tables: folders by bucket of ledgers, and scans that read the buckets they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Ledgers of a bucket, about a day of them. Part of the layout: never changed for a folder that has data.
BUCKET = 1 << 14


def bucket_of(ledger: str = "ledger_sequence") -> Column:
    return F.expr(f"{ledger} div {BUCKET}")


def parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files; no rows where it is missing."""
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows


def land(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Add rows to a landing folder: a folder for each bucket, rows in chain order inside each file."""
    order = [c for c in ("ledger_sequence", "tx_index", "op_index", "pos_in_op", "pos_in_tx") if c in rows.columns]
    dealt = rows.withColumn("bucket", bucket_of()).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", *order).write.mode(mode).partitionBy("bucket").parquet(path)


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A landing table with its ``bucket``, by which Spark prunes folders; no rows where it is missing."""
    return parquet(spark, path, f"{schema}, bucket bigint")


def edge_ledger(spark: SparkSession, path: str, network: str, oldest: bool) -> int | None:
    """The oldest or the newest ledger of a network that has landed: buckets are listed, and read from that end until one has it."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    for bucket in sorted((int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=") and n[7:].isdigit()), reverse=not oldest):
        rows = landed(spark, path, schemas.LEDGERS).where((F.col("bucket") == bucket) & (F.col("network") == network))
        found = rows.agg((F.min if oldest else F.max)("ledger_sequence")).first()[0]
        if found is not None:
            return found
    return None


def first_ledger(spark: SparkSession, path: str, network: str) -> int | None:
    return edge_ledger(spark, path, network, True)


def last_ledger(spark: SparkSession, path: str, network: str) -> int | None:
    return edge_ledger(spark, path, network, False)


def read_ledgers(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Ledgers ``first`` to ``last``; those that are missing are missing. The bounds reach the Parquet scan, and its folders where there are buckets."""
    if "bucket" in rows.columns:
        rows = rows.where(F.col("bucket").between(first // BUCKET, last // BUCKET))
    return rows.where(F.col("ledger_sequence").between(first, last))


@dataclass(frozen=True)
class LedgerSet:
    """Ledgers (network, ledger_sequence), with the buckets and bounds that a scan needs on the driver: a number a bucket."""

    frame: DataFrame
    buckets: tuple[int, ...]
    first: int
    last: int

    @staticmethod
    def of(frame: DataFrame) -> LedgerSet:
        rows = frame.groupBy(bucket_of().alias("bucket")).agg(F.min("ledger_sequence").alias("lo"), F.max("ledger_sequence").alias("hi")).collect()
        return LedgerSet(frame.select("network", "ledger_sequence"), tuple(r["bucket"] for r in rows), min((r["lo"] for r in rows), default=0), max((r["hi"] for r in rows), default=-1))


def of_ledgers(rows: DataFrame, ledgers: LedgerSet) -> DataFrame:
    """Rows of a set of ledgers, from their buckets alone."""
    found = rows.where(F.col("bucket").isin(*ledgers.buckets) & F.col("ledger_sequence").between(ledgers.first, ledgers.last)) if ledgers.buckets else rows.limit(0)
    return found.join(ledgers.frame, ["network", "ledger_sequence"], "left_semi")


def stream_table(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A landing table as a stream of files; the query's checkpoint is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_ledgers(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return stream_table(spark, path, schemas.LEDGERS, max_files)


def stream_dirty(spark: SparkSession, root: str, tables: list[str], max_files: int = 1000) -> DataFrame:
    """Ledgers of which anything lands in one of ``tables``, as one stream (network, ledger_sequence)."""
    every = None
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        rows = stream_table(spark, f"{root}/{name}", f"{schemas.LANDING[name]}, bucket bigint", max_files).select("network", "ledger_sequence")
        every = rows if every is None else every.unionByName(rows)
    return every


def registration_snapshot(spark: SparkSession, path: str, network: str) -> DataFrame:
    """Watched contracts of a network as they are now; read it again in each micro-batch."""
    return spark.read.schema(schemas.REGISTRATIONS).parquet(path).where(F.col("network") == network)


def static_snapshot(registrations: DataFrame, contract_id: str) -> DataFrame:
    return registrations.where(F.col("contract_id") == contract_id)
