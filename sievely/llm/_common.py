"""What the operators share: the shared folder, written tables, Arrow batches as byte arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts may be long, so far fewer than Spark's own 10,000.
BATCH_ROWS = 512
#: Bytes of text that one pass of array code works on; a longer text is a pass of its own. Array code takes some fifty
#: bytes for each, in every Python worker of an executor.
SLICE_BYTES = 600_000
#: Bitmaps of a filter (4 kB, 32,768 bits each) at most, and keys for each: 32 bits for a key, up to two million keys.
MOST_BITMAPS, BITMAP_KEYS = 2048, 1024
#: Bytes in which a filter is looked up: a join copies what it looks at, for each row.
PIECE = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="sievely-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of tables written on the way, for whoever asked for them to be deleted; each thread has its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of make(); the tables that make() wrote are deleted, since nothing reads them any more."""
    mine: list[str] = []
    before = _made.set(mine)
    try:
        found = make()
    finally:
        _made.reset(before)
    out = written(found, name)
    for path in mine:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column is called so (Spark's names ignore case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def repeats_ids(docs: DataFrame) -> bool:
    """Whether two rows share a doc_id; rows without one do not count."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def split_by(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be in the one column of keys, and the others, whose key is surely not in it (null keys are among these).

    The filter is a hash of each key as a bit; it is broadcast and has at most MOST_BITMAPS bitmaps. So only the first rows need a
    join. At 32 bits for a key some 3 % of the rows of other keys are among them, beyond two million keys more.
    """
    bits = 32768 * max(1, min(MOST_BITMAPS, -(-keys.count() // BITMAP_KEYS)))
    piece, held = fresh(rows.columns, "piece", "held")
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)) + 1
    pieces = 4096 // PIECE
    spots = keys.select(spot(keys.columns[0]).alias("spot")).select(F.bitmap_bucket_number("spot").alias("bucket"), F.bitmap_bit_position("spot").alias("bit"))
    # Dealt out before they are summed up, else each task would send bitmaps of its own.
    bitmaps = spots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    cut = bitmaps.select("bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("k"))
    found = written(cut.select((F.col("bucket") * pieces + F.col("k")).alias(piece), F.substring("bitmap", F.col("k") * PIECE + 1, F.lit(PIECE)).alias(held)), "filter")
    at = F.bitmap_bit_position(spot(key))
    of = F.bitmap_bucket_number(spot(key)) * pieces + F.floor(at / (8 * PIECE)).cast("long")
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") % PIECE + 1, F.lit(1))), 16, 10).cast("int")
    hit = (of == F.col(piece)) & F.col(key).isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.join(F.broadcast(found), hit, "left_semi"), rows.join(F.broadcast(found), hit, "left_anti")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches of whole texts. Plans are lazy, so the session keeps the setting; it is only ever lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column holds about `most` bytes in each; single rows are never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.zeros(batch.num_rows, np.int64)
        got = pc.binary_length(batch.column(column))
        lengths[:] = np.asarray(got.fill_null(0))
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets; null is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bytes of a word of 64 bits that count if so many are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes with inside[byte]; runs never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    is_in = inside[data]
    before = np.empty_like(is_in)
    before[0], before[1:] = False, is_in[:-1]
    after = np.empty_like(is_in)
    after[-1], after[:-1] = False, is_in[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[full[1:] - 1] = False
    starts = np.flatnonzero(is_in & ~before)
    ends = np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Hasher:
    """64-bit hashes of any spans of one byte array; with fold, A-Z count as a-z.

    Eight bytes at a time go through mix64, a bijection each time: spans of one length of up to eight bytes never collide,
    and longer ones have no algebra that regular texts could run into.
    """

    def __init__(self, data: np.ndarray, fold: bool = True):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = _LOWER[data] if fold else data
        self.eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        left = ends - starts
        out = mix64(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        live, at = slice(None), starts
        with np.errstate(over="ignore"):
            while len(at):
                block = self.eight[at].view("<u8")[:, 0] & _LEFT[np.minimum(left, 8)]
                out[live] = mix64((out[live] ^ block) * np.uint64(0xD6E8FEB86659FD93))
                more = left > 8
                live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
                at, left = at[more] + 8, left[more] - 8
        return out


#: Bytes that part words in the contracts: space and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = True
