"""What the operators of this subpackage share: reading tables, and tables kept between steps."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex classes of the contracts' white space and words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_FILE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def release(spark: SparkSession) -> None:
    """Gives back what the driver no longer uses: garbage of Python and of the JVM, and what the C library keeps of freed native memory.

    After the pipeline's first stages on sf0.01 the last was 160 of 977 MB, which no collection of
    garbage gives back. JVMs without that command (before 17.0.9, or not on Linux) do without it.
    """
    gc.collect()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        of, bean = jvm.java.lang.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        args[0], args[1] = bean, "systemTrimNativeHeap"
        # by the interface's method, as the server's own class is not open to callers
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return


class Scratch:
    """Tables written once in the shared folder, so that a lost executor costs no recomputation.

    ``drop`` removes them; whoever holds results that read them decides when. What nobody
    dropped goes at exit. With ``lean`` the driver's memory is released at the start and after
    every fourth table.
    """

    def __init__(self, spark: SparkSession, lean: bool = False):
        self.spark, self.lean = spark, lean
        if lean:
            release(spark)
        self.path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """rows: about how many there are at most, of a narrow table; it gets as few files as suit them."""
        self.count += 1
        if rows is not None:
            df = df.repartition(max(1, -(-rows // ROWS_A_FILE)))
        at = f"{self.path}/{self.count}"
        df.write.option("compression", "zstd").parquet(at)
        if self.lean and self.count % 4 == 0:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is None:
                return
            at = jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may already have ended
            return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, for operators that run Python there."""
    import io
    import zipfile
    from pathlib import Path

    # smaller batches than the default 64 MB: two workers beside the heap have to fit in an executor
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in (top / "__init__.py", *sorted((top / "llm").glob("*.py"))):
            z.writestr(f"{top.name}/{name.relative_to(top)}", name.read_bytes())
    at = f"{shared_dir(spark)}/{top.name}-{uuid.uuid4().hex}/{top.name}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)
