"""Helpers that several of the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A-Z to a-z and every ASCII byte outside the class to a space; bytes of other characters stay.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Bits of a membership bitmap: its size is fixed (2 MB), whatever the data hold.
BITMAP_BITS = 1 << 23

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-llm-")
    return f"file://{_own_dirs[app]}"


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.parquet(path)
        where, files = self._place(path)
        files.deleteOnExit(where)  # what is still read by a result goes when the application ends
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _place(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                where, files = self._place(path)
                files.delete(where, True)

    def keep_only(self, *frames: DataFrame) -> None:
        """Deletes all tables but these."""
        kept = {id(df) for df in frames}
        self.drop(*(df for df, _ in list(self.paths.values()) if id(df) not in kept))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it holds, batches to and from Python have so many rows at most: long texts then need less memory outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_batches(df: DataFrame, columns: list[str], fn: Callable[..., dict | None], schema: str, rows: int = 512, carry: list[str] = ()) -> DataFrame:
    """Calls fn on lists of the columns' values, a slice of a batch at a time; fn gives lists or arrays by name, or None for no rows.

    Columns in carry go along unchanged, before the others; fn then has to give a row for each it gets.
    """
    kept = T.StructType([df.schema[c] for c in carry])
    made = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(part.column(i).to_pylist() for i in range(n)))
                if out is not None:
                    fields = [*(part.schema.field(i).with_name(c) for i, c in enumerate(carry, n)), *arrow]
                    arrays = [*(part.column(i) for i in range(n, part.num_columns)), *(pa.array(out[f.name], f.type) for f in arrow)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    chosen = [*(df[c] for c in columns), *(df[c].alias(f"_carry{k}") for k, c in enumerate(carry))]
    return df.select(*chosen).mapInArrow(run, T.StructType([*kept.fields, *made.fields]))


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is not among the ids; only rows that may be are shuffled.

    A left join with a flag: the optimizer would push an anti join below the bitmap's join and shuffle every row.
    """
    bits, flag = bitmap(ids, key), free(df, "_gone")
    gone = ids.select(key).distinct().withColumn(flag, F.lit(True))
    left = maybe_in(df, key, bits).join(gone, key, "left").where(F.col(flag).isNull())
    return surely_not_in(df, key, bits).unionByName(left.select(*df.columns))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashed keys, at most BITMAP_BITS / 64 rows: a size bound for its broadcast."""
    slots = keys.where(F.col(key).isNotNull()).select(_slot(F.col(key)).alias("_slot"))
    words = slots.selectExpr("shiftright(_slot, 6) as _word", "shiftleft(1L, cast(_slot % 64 as int)) as _bit")
    return words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _looked_up(df: DataFrame, key: str, bits: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """df beside its key's word of the bitmap, and whether the key's bit is set."""
    slot, word, found = (free(df, x) for x in ("_slot", "_word", "_bits"))
    joined = df.withColumn(slot, _slot(F.col(key))).join(F.broadcast(bits.toDF(word, found)), F.shiftright(F.col(slot), 6) == F.col(word), how)
    return joined, F.expr(f"getbit({found}, cast({slot} % 64 as int)) = 1")


def maybe_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key may be among the bitmap's keys: all that are, and few others. It saves shuffling the rest."""
    joined, is_set = _looked_up(df, key, bits, "inner")
    return joined.where(is_set).select(*df.columns)


def surely_not_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The other rows, null keys among them."""
    joined, is_set = _looked_up(df, key, bits, "left")
    return joined.where(~F.coalesce(is_set, F.lit(False))).select(*df.columns)


def numbered(df: DataFrame, results: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df without columns of the results' names, the others numbered so that none is in an operator's way, and their numbers by name."""
    names = {c: f"c{i}" for i, c in enumerate(x for x in df.columns if x not in results)}
    return df.select(*(df[c].alias(n) for c, n in names.items())), names
