"""What the operators share: tables, the folder for cut lineage, and code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on the machine that asks; executors ask for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Let executors import this package even if the driver found it by its working folder: once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only a local session may do without: it gets a temporary one, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints"
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders of the operators that are at work, the innermost last; threads have their own.
_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A folder in the shared one for the tables that an operator writes; it goes when the block ends.

    Gives a function that writes a result beside that folder, so that it stays.
    """
    outer = _folders.get()[-1] if _folders.get() else checkpoint_dir(spark)
    own = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _folders.set((*_folders.get(), own))
    try:
        yield lambda df, name: _write(spark, df, f"{outer}/{name}-{uuid.uuid4().hex}")
    finally:
        _folders.reset(token)
        _delete(spark, own)


def _write(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, and lost executors cost no rerun of what made it."""
    return _write(spark, df, f"{_folders.get()[-1] if _folders.get() else checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, when nothing lazy reads it any more."""
    for f in df.inputFiles()[:1]:
        _delete(spark, f.rpartition("/")[0])


def text_bytes(column: pa.Array) -> pa.Array:
    """A string column of a batch, nulls as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.string()), "")


def null_as_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


#: Ids are broadcast up to so many bytes.
BROADCAST_BYTES = 4_000_000


def few(ids: DataFrame) -> DataFrame:
    """One column of ids, to be broadcast if it is small; joins with larger ones shuffle."""
    size = ids.agg(F.sum(F.octet_length(F.col(ids.columns[0]).cast("string")) + 8)).first()[0] or 0
    return F.broadcast(ids) if size <= BROADCAST_BYTES else ids


def few_keys(keys: DataFrame) -> DataFrame:
    """As :func:`few`, for keys of several columns."""
    size = keys.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in keys.columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def without_copies(df: DataFrame, marked: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` that ``marked`` (id, kept, ...; a row each) keeps, one row of each id; columns as they were.

    Of rows with one id one stays, chosen by hash of the row; rows without an id stay all.
    """
    rest = df.join(few(marked.where("NOT kept").select(id_col).distinct()), id_col, "left_anti")
    repeated = marked.where(F.col("kept") & F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if repeated.isEmpty():
        return rest.select(df.columns)
    repeated = few(repeated)
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(*df.columns), *[c for c in df.columns if c != id_col])
    name = "_" * (1 + max(map(len, df.columns)))  # clashes with no column
    once = rest.join(repeated, id_col, "left_semi").withColumn(name, F.row_number().over(order)).where(F.col(name) == 1)
    return rest.join(repeated, id_col, "left_anti").select(df.columns).unionByName(once.select(df.columns))


def filtered_by(df: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows of ``df`` whose text ``judge()`` (a function from a batch of texts to booleans, made once a task) keeps.

    Only texts go to Python and only booleans come back; columns stay as they were; no shuffle.
    """

    @F.arrow_udf(BooleanType())
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good = judge()
        for texts in batches:
            yield pa.array(good(text_bytes(texts)), pa.bool_())

    return df.where(keep(F.col(text_col)))
