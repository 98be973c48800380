"""What the operators share: staging in the cluster's shared folder, row keys, Arrow batches.

Intermediate tables are Parquet files under ``spark.checkpoint.dir``. They cut
the lineage and outlive any executor; nothing is kept in a folder of one machine.
"""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penalytics.session import ensure_checkpoint_dir
from penalytics.sources.tables import table_path

#: Rows and bytes of one Arrow batch handed to Python: texts may be long, so few rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


#: Folders that this application has made.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder, as a URI; never used twice."""
    _MADE.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def release(spark: SparkSession) -> int:
    """Delete the staged folders of this application, once no result that reads them is needed; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Applications whose Python workers have the package.
_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Call before using Python in tasks: gives workers this package, and small Arrow batches.

    The package goes to the executors as an archive through Spark itself, so it needn't be
    installed there. Batches stay small whatever the texts' length.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        # in the driver's folder for files to be served, which Spark deletes at the end
        folder = Path(SparkFiles.getRootDirectory()) / "packages"
        folder.mkdir(exist_ok=True)
        archive = folder / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """What opens files below a URI of the shared store, in tasks, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pyarrow.fs.FileSystem.from_uri(uri)


def whole(text: Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, as a struct of two longs."""
    t = whole(text)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("second"), t).alias("b"))


def shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ... and the new names of the columns ``names``, so that no
    column that an operator adds can clash. ``toDF(*docs.columns)`` gives the old names back."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    place = {n.lower(): i for i, n in reversed([*enumerate(docs.columns)])}
    return docs.toDF(*own), [own[place[n.lower()]] for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
