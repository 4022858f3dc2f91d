"""Packing documents into sequences: cutting stock by column generation over the histogram of document lengths."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.bpe import encoder_parts, worker_encoder
from docspark.llm.common import partitions, slices, stored

#: Tokens to which the patterns round long pieces up; the longest piece that fills what patterns leave; one document of
#: FILLERS is cut into pieces that do.
UNIT, SMALL, FILLERS = 16, 64, 50


def cut(n: int, size: int, filler: bool) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences and the rest, which a filler cuts into 32, 16, 8, 4, 2, 1 and so on."""
    rest = n % size
    lengths = [size] * (n // size)
    if filler:
        lengths += [x for _ in range(rest // 63) for x in (32, 16, 8, 4, 2, 1)]
        rest %= 63
        lengths += [x for x in (32, 16, 8, 4, 2, 1) if rest & x]
    elif rest:
        lengths.append(rest)
    return list(zip(np.cumsum([0, *lengths]).tolist(), lengths))


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan: a linear algebra library's own threads may never wake in a driver that has forked."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for i in range(m):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        rows = np.flatnonzero(both[:, i])
        rows = rows[rows != i]
        both[rows] -= both[rows, i, None] * both[i]
    return both[:, m:]


def generate_patterns(sizes: list[int], demand: list[int], capacity: int, most: int = 20_000) -> list[tuple[float, np.ndarray]]:
    """Basic solution (uses, pattern) of the linear program: fewest bins of ``capacity`` that hold each size ``demand`` times.

    Columns are generated: at the prices of the present basis, a knapsack over the capacity finds the pattern of most
    worth, which enters the basis while it is worth more than a bin. A pattern counts each size in a bin.
    """
    m = len(sizes)
    size, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    uses = (inverse * d).sum(axis=1)
    least = float((size * d).sum()) / capacity
    for step in range(most):
        if uses.sum() <= least * (1 + 1e-4) + 0.25:
            break
        price = inverse.sum(axis=0)
        worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            fit = size <= c
            options = np.where(fit, worth[np.maximum(c - size, 0)] + price, -np.inf)
            best = int(options.argmax())
            if options[best] > worth[c - 1]:
                worth[c], choice[c] = options[best], best
            else:
                worth[c] = worth[c - 1]
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        move = (inverse * column).sum(axis=1)
        rows = np.flatnonzero(move > 1e-9)
        ratios = uses[rows] / move[rows]
        out = int(rows[ratios.argmin()])
        far = max(0.0, float(ratios.min()))
        uses -= far * move
        uses[out] = far
        basis[:, out] = column
        inverse[out] /= move[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        if step % 200 == 199:
            inverse = _inverse(basis)
            uses = np.maximum((inverse * d).sum(axis=1), 0)
    return [(float(x), basis[:, i]) for i, x in enumerate(uses) if x > 0]


class Stock:
    """Pieces of each length that have no place yet, and the places given: rows (length, lo, hi, sequence, offset).

    The piece of a length that is ranked r, from lo to hi - 1, goes to the sequence r - lo after ``sequence``, at the offset.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left, self.taken, self.size = dict(counts), dict.fromkeys(counts, 0), size
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def fill(self, lengths: list[int], times: int) -> None:
        """Use ``times`` sequences with these pieces, and small ones in what is left, the longest that fit first."""
        room = self.size - sum(lengths)
        lengths = list(lengths)
        for x in lengths:
            self.left[x] -= times
        while room and times:
            fits = [x for x in range(min(room, SMALL), 0, -1) if self.left.get(x, 0) > 0]
            if not fits:
                break
            enough = [x for x in fits if self.left[x] >= times]
            if not enough:  # some of the sequences only
                some = max(self.left[x] for x in fits)
                for x in lengths:
                    self.left[x] += times
                self.fill(lengths, some)
                self.fill(lengths, times - some)
                return
            x = enough[0]
            more = min(room // x, self.left[x] // times)
            self.left[x] -= more * times
            lengths += [x] * more
            room -= more * x
        offset = 0
        for x in lengths:
            self.rows.append((x, self.taken[x], self.taken[x] + times, self.sequences, offset))
            self.taken[x] += times
            offset += x
        self.sequences += times


def _alike(groups: list[list[int]], left: dict[int, int], times: int):
    """For ``times`` sequences with a piece of each group of lengths: (lengths, times) of those with the same lengths.

    A group's pieces are taken in order of length, so there are few such stretches.
    """
    held = dict(left)
    runs = []
    for group in groups:
        need, own = times, []
        for x in group:
            if take := min(need, held.get(x, 0)):
                own.append((x, take))
                held[x] -= take
                need -= take
        runs.append(own)
    while times:
        n = min(own[0][1] for own in runs)
        yield [own[0][0] for own in runs], n
        times -= n
        for own in runs:
            own[0] = (own[0][0], own[0][1] - n)
            if not own[0][1]:
                own.pop(0)


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for all pieces (rows of a Stock), and the number of sequences.

    Pieces longer than SMALL are rounded up to classes of UNIT tokens, but for a few lengths. Patterns of classes are used as often as the whole
    part of the linear program's solution says; what they leave of a sequence, exactly known as a class is used up in
    order of length, is filled with small pieces. The long ones left over, at most a pattern's for each class, are dealt
    first-fit, and the small ones left over have patterns of their exact lengths.
    """
    stock = Stock(counts, size)
    if counts.get(size):
        stock.fill([size], counts[size])
    big = [x for x in counts if SMALL < x < size]
    for own, unit in ((big, 1 if len(big) <= 32 else max(1, min(UNIT, size // 256))), ([x for x in counts if x <= min(SMALL, size - 1)], 1)):
        classes: dict[int, list[int]] = {}
        for x in sorted(own, reverse=True):
            if stock.left[x]:
                classes.setdefault(-(-x // unit), []).append(x)
        if not classes:
            continue
        sizes = sorted(classes, reverse=True)
        total = lambda c: sum(stock.left[x] for x in classes[c])
        for uses, pattern in generate_patterns(sizes, [total(c) for c in sizes], size // unit):
            pattern = np.rint(pattern).astype(int).tolist()
            room = min(total(c) // a for c, a in zip(sizes, pattern) if a)
            if times := min(int(uses + 1e-6), room):
                groups = [classes[c] for c, a in zip(sizes, pattern) for _ in range(a)]
                for lengths, n in list(_alike(groups, stock.left, times)):
                    stock.fill(lengths, min(n, *(stock.left[x] // lengths.count(x) for x in lengths)))
        bins: list[list[int]] = []
        space = np.zeros(0, np.int64)
        for x in sorted(own, reverse=True):
            for _ in range(stock.left[x]):
                fits = np.flatnonzero(space >= x)
                if not len(fits):
                    bins.append([])
                    space = np.append(space, size)
                    fits = [len(bins) - 1]
                bins[fits[0]].append(x)
                space[fits[0]] -= x
        for lengths in bins:
            stock.fill(lengths, 1)
    return stock.rows, stock.sequences


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where each piece of a document lies.

    A document is its token ids and ``end_id``. One that fits a sequence stays whole, but for one of FILLERS (by a hash
    of id and tokens), which is cut into small pieces; a longer one is cut into whole sequences and a rest. At most
    ``size`` lengths exist, whatever the input. The driver gets their histogram and finds patterns and their uses;
    pieces are ranked within their length by counts of hashed buckets, never in one task, and ranks are looked up in the
    plan, whose rows are bounded by the number of lengths and patterns, for sequences and offsets.

    A null or empty text is its ``end_id`` alone. A very long text is encoded whole, in one task's memory. Every row gives
    its pieces, repeated rows too; a null doc_id stays null. Extra columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(encoder_parts(docs, path))
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder = worker_encoder(shared)
        for batch in batches:
            for part in slices(batch):
                rows = []
                ids, begin = encoder.encode_many([t or "" for t in part.column("text").to_pylist()])
                raw = memoryview(ids.tobytes())
                for doc, x, y in zip(part.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                    n = y - x + 1
                    filler = zlib.crc32(str(doc).encode(), zlib.crc32(raw[4 * x : 4 * y])) % FILLERS == 0
                    for start, length in cut(n, size, filler):
                        last = start + length == n
                        crc = zlib.crc32(raw[4 * (x + start) : 4 * (x + start + length - last)])
                        rows.append((doc, start, length, zlib.crc32(end, crc) if last else crc, n))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [part.schema.field("doc_id").type] + [pa.int64()] * 4)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(partitions(spark)))
    pieces = stored(pieces.withColumn("bucket", bucket), "pieces")
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.array(sorted(plan(histogram, size)[0]), np.int64).reshape(-1, 5)
    spots = spark.sparkContext.broadcast(rows)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    counts = counts.select("length", "bucket", before.alias("before"))
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")))
    ranked = ranked.join(counts.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("row") - 1)

    def place(batches):
        length, lo, _, sequence, offset = spots.value.T
        keys = length << 48 | lo
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            own = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + rank - lo[at]), pa.array(offset[at])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
