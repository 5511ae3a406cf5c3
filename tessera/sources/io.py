"""Sources and sinks.

All writes go under a caller-given base path; the query registry uses the
cluster's shared ``spark.checkpoint.dir`` (never a machine-local folder).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.keys import with_surrogate
from tessera.session import checkpoint_dir

CORRUPT = "_corrupt_record"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scan(spark: SparkSession, source: str, schema: T.StructType | None = None, query: str | None = None,
         fmt: str = "parquet", jdbc_options: dict | None = None) -> DataFrame:
    """Parquet/CSV/JSON path, or a JDBC source (``source`` = JDBC URL).

    For JDBC the query runs on the database and Spark reads it in parallel
    when ``partitionColumn/lowerBound/upperBound/numPartitions`` are given."""
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(**jdbc_read_options(source, query, jdbc_options)).load()
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(source)
    return df.select(*[f.name for f in schema.fields]) if schema is not None else df


def jdbc_read_options(url: str, query: str | None = None, extra: dict | None = None) -> dict[str, str]:
    """Options of a JDBC read. A query is given as a derived table: Spark refuses its ``query`` option together
    with ``partitionColumn``."""
    out = {"url": url, **{k: str(v) for k, v in (extra or {}).items()}}
    if query:
        out["dbtable"] = f"({query}) q"
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name (never by position) with its types;
    missing columns become NULL."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def stage(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Staging snapshot: conform by name, overwrite, read back."""
    conform(df, schema).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def ingest(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", id_col: str = "id",
           **options) -> tuple[DataFrame, DataFrame]:
    """S3: bulk extract ingestion with bad-record capture.

    Returns (good rows with ``id_col`` = 1-based position in the extract,
    rejected raw lines). Positions follow file order then line order: the
    (file, split start, position in split) order is line order, and W2 turns
    it into dense ids without a single-task window."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    r = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    for k, v in options.items():
        r = r.option(k, v)
    raw = r.format(fmt).load(path)
    raw = (raw.withColumn("_file", F.col("_metadata.file_path"))
           .withColumn("_start", F.col("_metadata.file_block_start"))
           .withColumn("_pos", F.monotonically_increasing_id()))
    raw = with_surrogate(raw, ["_file", "_start", "_pos"], id_col)
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file", "_start", "_pos")
    bad = raw.filter(F.col(CORRUPT).isNotNull()).select(id_col, F.col(CORRUPT).alias("raw_line"))
    return good, bad


STANDARD_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def csv_with_encoding(spark: SparkSession, encoding: str) -> None:
    """Legacy code pages (e.g. windows-1252 from Windows tools) are outside
    the default CSV charset list; enable the JVM's full charset list for them."""
    if encoding.lower() not in STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path: str, schema, encoding: str = "utf-8", header: bool = True) -> DataFrame:
    """CSV scan with header and a possibly legacy encoding."""
    csv_with_encoding(spark, encoding)
    return spark.read.option("header", header).option("encoding", encoding).schema(schema).csv(path)


def sink(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parallel Parquet writers, partitioned (e.g. by year) for pruning."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def observed_sink(df: DataFrame, path: str, table: str, source: str, partition_by: list[str] | None = None,
                  source_rows: DataFrame | None = None, log_base: str | None = None) -> DataFrame:
    """S6 + S10: write, then return the audit-log row of that load: rows of the source and rows found in the
    written table.

    The frame is computed once: inserted rows come from the Parquet footers of what was written; ``source_rows`` is the
    staged source whose rows are counted (not given: everything read was inserted). With ``log_base`` the row is also appended to the log
    kept there, that of a failed load too. A failed load raises; its row is carried by the exception (``LoadError.log``)."""
    t0 = dt.datetime.now()
    status, err, n_src, n_ins, cause = "OK", None, 0, 0, None
    try:
        sink(df, path, partition_by)
        n_ins = df.sparkSession.read.parquet(path).count()
        n_src = source_rows.count() if source_rows is not None else n_ins
    except Exception as ex:  # noqa: BLE001 - the error is the log's content
        status, err, cause = "ERREUR", str(ex)[:4000], ex
    row = log_row(df.sparkSession, table, source, t0, n_src, n_ins, status, err, int((dt.datetime.now() - t0).total_seconds()))
    if log_base:
        append_log(row, log_base)
    if cause is not None:
        raise LoadError(err, row) from cause
    return row


def append_log(row: DataFrame, base: str) -> None:
    """Add a row to the accumulating log (S10); its number orders loads, and loads at the same time keep files of their own."""
    n = _highest(row.sparkSession, f"{base}/_log", "n long")
    row.withColumn("n", F.lit(n + 1)).coalesce(1).write.mode("append").parquet(f"{base}/_log")


def read_log(spark: SparkSession, base: str) -> DataFrame:
    """The log of all loads so far, numbered (an empty frame before the first)."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("n", T.LongType())])
    return spark.read.schema(schema).parquet(f"{base}/_log") if _exists(spark, f"{base}/_log") else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _highest(spark: SparkSession, path: str, schema: str) -> int:
    return (spark.read.schema(schema).parquet(path).agg(F.max("n")).first()[0] or 0) if _exists(spark, path) else 0


def load_keys(spark: SparkSession, ids: DataFrame, base: str, source: str, name: str) -> DataFrame:
    """W1/W2 across loads: the persisted (source, key) map below ``base``, extended by the ids of this load and written as
    a new version; the highest version counts."""
    from tessera.operators.keys import extend_keys
    version = _highest(spark, f"{base}/_keys", "n long")
    schema = T.StructType([T.StructField(source, ids.schema[source].dataType), T.StructField(name, T.LongType())])
    known = spark.read.schema(schema).parquet(f"{base}/v{version}") if version else None
    extend_keys(known, ids, source, name).write.mode("overwrite").parquet(f"{base}/v{version + 1}")
    spark.createDataFrame([(version + 1,)], "n long").coalesce(1).write.mode("append").parquet(f"{base}/_keys")
    return spark.read.schema(schema).parquet(f"{base}/v{version + 1}")


def bucketed(df: DataFrame, name: str, key: str, buckets: int, base: str) -> DataFrame:
    """S6 + S8: a table bucketed and sorted by ``key`` in the shared folder. Tables with as many buckets join and
    aggregate on the key without an exchange. One file per bucket: rows are dealt by the key before they are written."""
    path = f"{base}/{name}"
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path)
     .format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


class LoadError(RuntimeError):
    """A load that failed, with its audit-log row."""

    def __init__(self, message: str, log: DataFrame):
        super().__init__(message)
        self.log = log


LOG_SCHEMA = T.StructType([
    T.StructField("nom_table", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("date_execution", T.TimestampType()), T.StructField("nb_lignes_source", T.LongType()),
    T.StructField("nb_lignes_insert", T.LongType()), T.StructField("statut", T.StringType()),
    T.StructField("message_erreur", T.StringType()), T.StructField("duree_secondes", T.LongType()),
])


def log_row(spark, table, source, when, n_src, n_ins, status, err, secs) -> DataFrame:
    """One audit row (the ``etl_log`` table's columns)."""
    return spark.createDataFrame([(table, source, when, int(n_src), int(n_ins), status, err, int(secs))], LOG_SCHEMA)


def reload(tables: dict[str, DataFrame], base: str, run_id: str) -> str:
    """Clear-and-reload as write-new-then-swap. Every table is written
    under ``base/run_id``; only then a new numbered pointer is added below ``_current``, so readers
    never see a half-loaded warehouse nor a moment without a pointer, and a rerun is idempotent."""
    target = f"{base}/{run_id}"
    for name, df in tables.items():
        sink(df, f"{target}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(_last_pointer(spark, base)[0] + 1, run_id)], POINTER).coalesce(1) \
        .write.mode("append").parquet(f"{base}/_current")
    return target


POINTER = "n long, run_id string"


def _last_pointer(spark: SparkSession, base: str) -> tuple[int, str | None]:
    """The highest committed pointer (0, None before the first load)."""
    if not _exists(spark, f"{base}/_current"):
        return 0, None
    row = spark.read.schema(POINTER).parquet(f"{base}/_current").agg(F.max(F.struct("n", "run_id"))).first()[0]
    return (row["n"], row["run_id"]) if row else (0, None)


def current(spark: SparkSession, base: str) -> str:
    """Path of the warehouse version that the highest pointer names."""
    return f"{base}/{_last_pointer(spark, base)[1]}"


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A small result table (model metrics, sweep, report) written as one
    JSON/Parquet file set next to the warehouse."""
    df.coalesce(1).write.mode("overwrite").format(fmt).save(path)
