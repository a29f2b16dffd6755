"""What the text operators share: word rules, row keys, shared-folder tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java patterns of a run of space bytes; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
#: The characters of SPACE.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that may be broadcast; a table with more is joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Bytes of a written table for each partition of what is made from it, see few().
PARTITION_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Array of the words of a text, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast built-in where a text is pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """As table(), dealt to buckets by key as a shuffle would: joins by key read it without shuffling it again."""
    spark = df.sparkSession
    held = f"strandframe_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(held)
    out = spark.table(held)
    out.written_to, out.held_as = path, held
    return out


def few(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, a shuffle's outcome no larger than the written table ``source``, in as many partitions as the bytes of source ask for: a small
    outcome is else written as one file for each shuffle partition, and on local paths each file starts three processes (chmod)."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(source.written_to)
    written = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return df.coalesce(max(1, -(-written // PARTITION_BYTES)))


def discard(*tables: DataFrame) -> None:
    """Deletes what table() or dealt() wrote, once nothing reads it any more."""
    for t in tables:
        spark = t.sparkSession
        if held := getattr(t, "held_as", None):
            spark.sql(f"DROP TABLE IF EXISTS {held}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished jobs now; it learns of them only when the driver collects garbage.
    What the driver's native allocator then holds free goes back to the system: after hundreds of plans that is some 170 MB."""
    spark._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Whether the driver's JVM gave free native memory back; only some can (Java 17.0.9 or later with glibc)."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds = [jvm.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        types, values = array(jvm.Class, 4), array(jvm.Object, 4)
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        for i, (kind, value) in enumerate(zip(kinds, (name, "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)), strict=True)):
            types[i], values[i] = kind, value
        # by the interface's method: the server's own class is not open to reflection
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def _bytes(df: DataFrame) -> Column:
    """About the bytes that a row of df takes once it is broadcast."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    each = [F.lit(32 + 16 * len(df.columns))]
    for c, kind in df.dtypes:
        if kind in wide:
            each.append(F.coalesce(wide[kind](F.col(f"`{c}`")), F.lit(0)))
        elif kind.startswith("array"):
            each.append(F.greatest(F.size(F.col(f"`{c}`")), F.lit(0)) * 16)
    total = each[0].cast("long")
    for e in each[1:]:
        total = total + e
    return total


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, an already written table, marked for broadcast if its rows take at most so many bytes; else Spark joins it by a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(_bytes(df))).first()[0] or 0) <= most else df


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with the new columns last; input columns of the same name (case apart) give way."""
    taken = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in new.items()])
