"""What the operators of this package share: tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Rows that one Arrow batch carries to a Python worker; texts may be long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a session on one machine that has none, as in tests, gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verbascope-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs no more."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Shelf:
    """A folder of intermediate tables, deleted once the work that needs them is done without an error.

    What is returned from inside must not read them any more when it is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, fresh_dir(spark, name), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, error, *_) -> None:
        if error is None:
            remove(self.spark, self.path)


#: Parts into which a hot key is split before it is joined.
SALTS = 63


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def salts() -> Column:
    """The column ``salt`` of a group's rows, as a bit set."""
    return F.expr("bit_or(shiftleft(1L, salt))").alias("salts")


def split(places: DataFrame) -> DataFrame:
    """A row of ``places`` for each salt in its bit set ``salts``: no more than its group has rows."""
    return places.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1))).drop("salts")


def folded(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % modulus


#: What the tasks of this worker share, by its owner's name.
_shared: dict[str, object] = {}


def give_up(keep: str | None = None) -> None:
    """Frees what other operators' tasks have left in this worker: workers are used again, and would hold it for as long as they live."""
    gone = [k for k in _shared if k != keep]
    for k in gone:
        del _shared[k]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def shared(name: str, make: Callable[[], object]) -> object:
    """What ``make`` made when a task of this worker first asked for ``name``; anything else that is shared is given up."""
    give_up(name)
    if name not in _shared:
        _shared[name] = make()
    return _shared[name]


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch in this session, as operators hold a batch of whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def over_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], shares: str | None = None) -> DataFrame:
    """``mapInArrow`` by whole batches; ``shares`` is the name of what its tasks share.

    ``make`` runs once a task and returns what turns a record batch into a
    dict of columns in the order of ``schema``. A session whose Arrow batches
    may have more than ``BATCH_ROWS`` rows is set to that many.
    """
    spark = df.sparkSession
    small_batches(spark)
    target = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up(shares)
        step = make()
        for batch in batches:
            out = step(batch)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, target.field(k).type) for k, x in out.items()], schema=target
            )
        # workers are used again by other operators, which have memory of their own
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
