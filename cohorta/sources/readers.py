"""Sources: CSV/TSV/CSV.GZ, Parquet file, Parquet folder, typed empty tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.sources.csvfile import read_csv


def _jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _jvm_fs(spark, path)
    return bool(fs.exists(p))


def has_parquet(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds at least one .parquet file (recursively)."""
    if not path_exists(spark, path):
        return False
    fs, p = _jvm_fs(spark, path)
    it = fs.listFiles(p, True)
    while it.hasNext():
        name = it.next().getPath().getName()
        if name.endswith(".parquet") and not name.startswith(("_", ".")):
            return True
    return False


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, partition) of the Parquet files below ``path``; only names are read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*.parquet").option("recursiveFileLookup", True)
             .load(path).select("path", F.col("length").alias("bytes")))
    return files.withColumn("partition", F.regexp_extract("path", r"((?:/[^/=]+=[^/]*)*)/[^/]*$", 1))


def footer_rows(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``) and the ``rows`` that each file's footer states."""
    fields = files.schema

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                uri = "file:///" + name[5:].lstrip("/") if name.startswith("file:") else name
                system, at = fs.FileSystem.from_uri(unquote(uri) if uri.startswith("file:") else uri)
                with system.open_input_file(at) as file:
                    rows.append(pq.read_metadata(file).num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], [*batch.schema.names, "rows"])

    return files.mapInArrow(read, T.StructType([*fields.fields, T.StructField("rows", T.LongType())]))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Import source by extension.  CSV is read as all-string columns (no
    inference pass over the data); types come from the target schema.  Quoted
    text doubles its quotes and may hold line breaks (``sources.csvfile``)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"file not found: {path}")
    low = path.lower()
    if low.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path)
    if low.endswith(".tsv"):
        return read_csv(spark, path, "\t")
    if low.endswith(".gz"):
        raise ValueError(f"unsupported gzipped type: {path}")
    if low.endswith(".parquet"):
        return spark.read.option("mergeSchema", True).parquet(path)
    if "." in path.rsplit("/", 1)[-1]:
        raise ValueError(f"unsupported file type {path}")
    # a folder: every parquet file below it, file columns are the truth
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True) \
                .parquet(path)


def source_columns(df: DataFrame) -> dict[str, str]:
    """Lower-cased source name -> actual name (case-insensitive discovery)."""
    return {c.lower(): c for c in df.columns}


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """Parquet table at ``path`` with an explicit schema, or an empty typed
    relation when no file exists yet."""
    if not has_parquet(spark, path):
        return empty_table(spark, schema)
    r = spark.read.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.parquet(path)


def scan_lake(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """External lake with Hive partitions (``account_id=...``): explicit schema,
    partition pruning on ``account_id``."""
    return table_or_empty(spark, path, schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: same-named columns cast to the target
    type, missing columns as typed NULLs, extra columns dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
                       .alias(f.name) for f in schema.fields])
