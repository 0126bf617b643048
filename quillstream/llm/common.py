"""What the operators of this subpackage share: staged tables, ragged Arrow columns, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, a folder of our own if
    driver and executors are one process, and an error otherwise, as no local folder is shared."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillstream-"))
    return _own_dir[0]


class Staging:
    """Tables written to the shared folder, so that a lost executor costs no more than one stage.

    What is left of them when the application ends is deleted then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillstream/{uuid.uuid4().hex}"
        self.made = 0
        path, files = self._files(self.root)
        files.deleteOnExit(path)

    def _files(self, where: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def path(self) -> str:
        """A new place below the folder."""
        self.made += 1
        return f"{self.root}/{self.made}"

    def write(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a Parquet table."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def forget(self, made: int) -> None:
        """Deletes what is at the place made as number `made`, from 1."""
        path, files = self._files(f"{self.root}/{made}")
        files.delete(path, True)

    def drop(self, *made: DataFrame) -> None:
        """Deletes tables made by write()."""
        for df in made:
            self.forget(int(df._staged_at.rsplit("/", 1)[1]))


#: Rows of one key from which a join on it is dealt out.
HOT = 1 << 17
_SHARES = 64


def join_hot(many: DataFrame, n: int, one: DataFrame, key: str | list[str], row: Column, how: str = "inner", hot: int = HOT) -> DataFrame:
    """many.join(one, key, how), `many` having n rows and `one` one row a key: the rows of a key that has `hot` rows or
    more are dealt out by a hash of `row`, and that key's row of `one` goes to every share.

    Tables of up to `hot` rows have no such key.  The hot keys are at most n / hot, so they may be broadcast."""
    if n <= hot:
        return many.join(one, key, how)
    key = [key] if isinstance(key, str) else key
    heavy = F.broadcast(many.groupBy(*key).agg(F.count("*").alias("quillstream_n")).where(F.col("quillstream_n") >= hot).withColumn("quillstream_hot", F.lit(True)).drop("quillstream_n"))
    share, shares = F.pmod(F.xxhash64(row), F.lit(_SHARES)).cast("int"), F.sequence(F.lit(0), F.lit(_SHARES - 1))
    left = many.join(heavy, key, "left").withColumn("quillstream_share", F.when(F.col("quillstream_hot"), share).otherwise(0)).drop("quillstream_hot")
    right = one.join(heavy, key, "left").withColumn("quillstream_share", F.explode(F.when(F.col("quillstream_hot"), shares).otherwise(F.array(F.lit(0))))).drop("quillstream_hot")
    return left.join(right, [*key, "quillstream_share"], how).drop("quillstream_share")


#: Bits of a filter, at most: 16 MB.
_MOST_BITS = 1 << 27
_PIECE_BITS = 1 << 15
#: Bytes of a filter that one row of the table holds, so that little is copied for each row that is tested.
_CHUNK = 64


class BitFilter:
    """A bit for each hash of some keys: rows whose bit is not set are not among them.  It keeps rows out of a shuffle and
    decides nothing; its size is bounded, so it may be broadcast, and where it fills up more rows are moved, with the same result."""

    def __init__(self, staging: Staging, keys: DataFrame, *columns: str):
        n = keys.count()
        self.bits = _PIECE_BITS
        while self.bits < min(32 * n, _MOST_BITS):
            self.bits *= 2
        at = keys.select(self._place(*columns).alias("at"))
        pieces = at.groupBy(F.floor(F.col("at") / _PIECE_BITS).alias("quillstream_piece"))
        pieces = pieces.agg(F.bitmap_construct_agg(F.col("at") % _PIECE_BITS).alias("bits"))
        each = _PIECE_BITS // 8 // _CHUNK
        chunks = pieces.select("quillstream_piece", "bits", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
        chunks = chunks.select((F.col("quillstream_piece") * each + F.col("k")).alias("quillstream_piece"), F.substring("bits", F.col("k") * _CHUNK + 1, F.lit(_CHUNK)).alias("quillstream_bits"))
        self.pieces = staging.write(chunks)

    def _place(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def rows(self, df: DataFrame, *columns: str, found: bool = True) -> DataFrame:
        """The rows whose bit is set, or those whose bit is not."""
        at = self._place(*columns)
        byte = F.hex(F.substring("quillstream_bits", (F.floor(at % (8 * _CHUNK) / 8) + 1).cast("int"), F.lit(1)))
        is_set = F.coalesce(F.getbit(F.conv(byte, 16, 10).cast("long"), (at % 8).cast("int")) == 1, F.lit(False))
        placed = df.withColumn("quillstream_piece", F.floor(at / (8 * _CHUNK)))
        return placed.join(F.broadcast(self.pieces), "quillstream_piece", "left").where(is_set == F.lit(found)).select(df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signed(values: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark's long."""
    return pa.array(values.view(np.int64))


def ragged(values: pa.Array, ptr: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), values)


def ragged_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def bytes_column(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into pieces of about `limit` bytes of the text column `name`, whole rows at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes: their byte planes one after the other, compressed, so that high planes of zeros cost nothing."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()
    return len(planes).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), blob[8]
    planes = pa.decompress(blob[9:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T)
    return flat.reshape(-1).view(f"u{width}")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as their differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)
