"""What the operators of this subpackage share: words, hashes, stored tables and packed blocks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        at = tempfile.mkdtemp(prefix="docspark-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    ``by`` names a column of few values whose rows are read apart from each other later.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    (write.partitionBy(by) if by else write).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def unstore(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage: what finished rounds broadcast and shuffled goes, and the heap shrinks.

    Spark frees both only when the driver's references to them are collected; until then a small heap grows to its limit.
    """
    spark.sparkContext._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= M1
        x ^= x >> np.uint64(32)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and where each value begins (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (and in all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * M2)
    rows, at = np.arange(len(starts)), starts
    with np.errstate(over="ignore"):
        while len(rows):
            piece = loads[at] & _MASKS[np.minimum(left, 8)]
            if len(rows) == len(out):
                out = mix((out ^ piece) * M1 + M2)
            else:
                out[rows] = mix((out[rows] ^ piece) * M1 + M2)
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (of all words, where a text has 1 to k - 1), and for each text the number before it."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * M2 + np.uint64(seed)) | np.uint64(1)
    with np.errstate(over="ignore"):
        short = np.repeat((n < k) & (n > 0), counts)
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            if len(words):
                out += words[np.minimum(at + j, len(words) - 1)] * factors[j]
        for row in np.flatnonzero(short):
            own = words[at[row] : at[row] + n[np.searchsorted(begin, row, "right") - 1]]
            out[row] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), begin


def pack(table: pa.Table | pa.RecordBatch, level: int = 3) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def slices(batch: pa.RecordBatch, rows: int = 5000, size: int = 7_000_000):
    """Parts of a batch, each of at most ``rows`` rows and ``size`` bytes of text, or of one longer text."""
    ends, at = utf8(batch.column("text"))[1], 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def in_blocks(batches, rows: int, size: int):
    """Tables of neighbouring rows with a column text, each with a number that no other block of any task has.

    A block ends after ``rows`` documents or ``size`` bytes of text, so its memory is bounded but for a single long text.
    """
    import pyspark

    part = pyspark.TaskContext.get().partitionId()
    held, n, mass, seq = [], 0, 0, 0
    for batch in batches:
        lengths = np.diff(utf8(batch.column("text"))[1])
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            fit = int(np.searchsorted(np.cumsum(lengths[at : at + take]), size - mass, "right"))
            take = max(1 if not n else 0, min(take, fit))
            if take:
                held.append(batch.slice(at, take))
                n, mass, at = n + take, mass + int(lengths[at : at + take].sum()), at + take
            if held and (n >= rows or at < batch.num_rows or mass >= size):
                yield (part << 32) + seq, pa.Table.from_batches(held).combine_chunks()
                held, n, mass, seq = [], 0, 0, seq + 1
    if held:
        yield (part << 32) + seq, pa.Table.from_batches(held).combine_chunks()


def blocks(docs: DataFrame, rows: int = 3000, size: int = 8_000_000, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Documents packed into blocks (block, blob) of neighbouring rows, stored in the shared folder."""

    def run(batches):
        for block, table in in_blocks(batches, rows, size):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(table)], pa.binary())], ["block", "blob"])

    return stored(docs.select(*columns).mapInArrow(run, "block long, blob binary"), "blocks")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (id, component) with the smallest id reachable.

    Alternating large-star and small-star rounds of equi-joins and grouped minima; each round's edges are a stored
    table, and rounds end when count and checksum of the edges stay. The minima are dealt anew by ``k``, equal to the
    node but not the column they were grouped by, as Spark splits a skewed join only between two shuffles of its own;
    so a hub's edges can be split. Edges with a null end or from a node to itself count for nothing.
    """
    same = F.bitwise_not(F.bitwise_not("a"))
    now, before = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1L))")).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(same.alias("k"), "m")
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(same.alias("k"), "m")
        small = large.join(down, F.col("a") == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(down.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), name)
        unstore(now)
        now = after
        del both, least, large, down, small  # plans that hold this round's broadcasts
        collect_garbage(now.sparkSession)


def sorted_groups(batches, key: str):
    """Tables of the rows of one key each, from record batches sorted by that key; all small groups of a batch in one table.

    Yields (table, bounds): group i has the rows bounds[i] to bounds[i + 1].
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            head = table.slice(0, cut).combine_chunks()
            yield head, np.concatenate([[0], np.flatnonzero(np.diff(keys[:cut])) + 1, [cut]])
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])
