"""Tables that steps share, in a folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Java compiles no method of more bytes, but interprets it; above this size Spark had better generate many small ones.
COMPILED, LIMIT = "8000", "spark.sql.codegen.hugeMethodLimit"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows as a table in the shared folder, read again: several steps read it without computing it anew. A filter on columns ``by`` reads their rows alone.

    While it is written the session's limit of generated methods is that of the Java compiler: the plans of features and windows are above it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, COMPILED)
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(LIMIT, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
