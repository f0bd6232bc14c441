"""What the corpus operators share: tables, the shared folder, Arrow batches, byte arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflux.sources.sinks import materialized

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
SLAB = 1 << 18
#: Bytes of an Arrow batch, where the session has Spark's default: what a Python worker holds at once.
ARROW_BYTES = 4 << 20
#: Bytes of a batch that goes back, about.
OUT_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does so itself. Idle workers keep what they once held."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, str(ARROW_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    The plan behind df ends there: a lost executor costs no more than the tasks
    that read the table, and what df held is fixed even where its order was not.
    """
    small_batches(df.sparkSession)
    return materialized(df)


def forget(df: DataFrame) -> DataFrame:
    """df, a table; what the driver no longer refers to goes, and with it the shuffle files of the steps that made df, which it doesn't need."""
    for _ in range(2):  # what the first leaves unreachable goes with the second
        gc.collect()
        df.limit(0).collect()
        df.sparkSession._jvm.System.gc()
    return df


def hold_out(doc_id) -> "F.Column":
    """crc32 of the id written as text, mod 3, is 1: rows that no model learns from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns that operators work on, whatever else docs holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def give_back() -> None:
    """Return freed memory to the system, where the C library can: idle workers else keep what they once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What this worker process keeps from one task to the next, by what made it.
_kept: dict[tuple[Callable, str], object] = {}


def keep(make: Callable, path: str):
    """make(path), made once by a worker process and kept until it gets a task that doesn't keep such things."""
    if (make, path) not in _kept:
        _kept[make, path] = make(path)
    return _kept[make, path]


def let_go(but: tuple[Callable, ...] = ()) -> None:
    """What this process keeps goes, but for what is made by one of `but`."""
    gone = [k for k in _kept if k[0] not in but]
    for key in gone:
        del _kept[key]
    if gone:
        gc.collect()  # a cache and what fills it refer to each other
        give_back()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: tuple[Callable, ...] = ()) -> DataFrame:
    """mapInArrow; batches go out in parts of about OUT_BYTES, and a worker gives its memory back now and then and when its task is done.

    keeps: of what keep() made for other tasks, only things of these makers stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        sent = 0
        try:
            for batch in fn(batches):
                step = max(1, len(batch) * OUT_BYTES // max(1, batch.nbytes))
                for k in range(0, len(batch), step):
                    yield batch.slice(k, step)
                sent += batch.nbytes
                if sent > 16 * OUT_BYTES:
                    give_back()
                    sent = 0
        finally:
            forget_powers()
            give_back()

    return df.mapInArrow(run, schema)


def map_texts(docs: DataFrame, per_batch: Callable[[list, list], dict], schema: str, keeps: tuple[Callable, ...] = ()) -> DataFrame:
    """per_batch(ids, texts) for each Arrow batch of (doc_id, text); it returns columns by name.

    Null texts come as None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = per_batch(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(docs, run, schema, keeps)


def byte_slabs(batch: pa.RecordBatch, limit: int = SLAB) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The batch's (ids, bytes, bounds) in runs of whole texts of at most limit bytes.

    Text i is bytes[bounds[i]:bounds[i + 1]]; nulls are empty.
    """
    ids = batch.column(0).to_pylist()
    texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield ids[first:last], raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33, S29, S32 = np.uint64(33), np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches all output bits (fmix64)."""
    x = x ^ (x >> S33)
    x *= MIX_1
    x ^= x >> S33
    x *= MIX_2
    x ^= x >> S33
    return x


#: An odd multiplier, so that it has an inverse modulo 2**64.
RADIX = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLAB + 4096)
        for k, base in enumerate((RADIX, pow(RADIX, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def forget_powers() -> None:
    """They are soon made again; a pass of 1 MB leaves 16 MB of them."""
    _powers[:] = [x[:1].copy() for x in _powers]


class Rolling:
    """Hashes of any runs of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k consecutive symbols."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


#: A 64-bit symbol for each byte value.
BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(RADIX))

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a slab: runs of bytes that separators (a table of 256 booleans) don't hold.

    starts, ends: byte positions; bounds: the words of text i are bounds[i]:bounds[i + 1].
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES):
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(separators[data], out=inside[1:-1])
        before, now = inside[:-1], inside[1:]
        edge = before != now
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        both = np.zeros(len(data) + 1, bool)
        both[cuts] = before[cuts] & now[cuts]  # a text ends and the next begins within a run
        self.starts = np.flatnonzero((edge & now) | both)
        self.ends = np.flatnonzero((edge & before) | both)
        self.bounds = np.searchsorted(self.starts, bounds)
        self.data = data

    def hashes(self) -> np.ndarray:
        return Rolling(BYTE_SYMBOLS[self.data]).runs(self.starts, self.ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z and all else as it is."""
    return data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
