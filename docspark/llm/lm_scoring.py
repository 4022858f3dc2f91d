"""LM scoring with a log-frequency Bloom filter of quantised bigram counts, probed segment by segment where it is built."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import LOWER, M1, M2, in_blocks, mix, partitions, sorted_groups, span_hashes, stored, utf8, word_spans

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Taken off each kept count, and the weight of the unigrams.
DISCOUNT, PRIOR = 0.75, 1.0
#: Of the filter: bits that one probe tests in a 64-bit word, and entries to a line of words, one word for each probe.
BITS, LOAD = 6, 2
#: Training tokens to a segment of bigrams and bytes of text to a bucket of words, which bound a task's memory.
ROOM, WORDS_ROOM = 1 << 21, 1 << 26
#: The bits that a probe tests, by 12 bits of hash.
_MASKS = (np.uint64(1) << np.argsort(np.random.default_rng(7).random((1 << 12, 64)), axis=1, kind="stable")[:, :BITS].astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in arrays)
    sizes = np.array([x.nbytes for x in arrays], "<u4").tobytes()
    return sizes + bytes(pa.Codec("zstd").compress(raw, asbytes=True)) if raw else sizes


def _expand(blob: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<u4", len(types))
    total = int(sizes.sum())
    raw = pa.Codec("zstd").decompress(blob[4 * len(types) :], total, asbytes=True) if total else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], t) for s, e, t in zip(sizes, ends, types)]


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of each integer, in planes, which compress better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)


def _integers(planes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((planes.size // n, 8), np.uint8)
    out[:, :n] = planes.reshape(n, -1).T
    return out.view("<u8").ravel()


def _rows(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


_SENT = (["kind", "bucket", "block", "blob"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()])
_SENT_SCHEMA = "kind int, bucket long, block long, blob binary"


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), [len(keys)]]) if len(keys) else np.zeros(1, int)


class Block:
    """Neighbouring documents: ids, how many tokens each has (its words and one end), the block's distinct hashes in
    order, with the start of a text among them, and tokens as places among those."""

    def __init__(self, ids: list, counts: np.ndarray, hashes: np.ndarray, tokens: np.ndarray):
        self.ids, self.counts, self.hashes, self.tokens = ids, counts, hashes, tokens
        self.start = int(np.searchsorted(hashes, START))
        self.held = np.array([i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool)
        self.learned = np.repeat(~self.held, counts)

    @classmethod
    def read(cls, table: pa.Table) -> Block:
        ids = table.column("doc_id").to_pylist()
        data, at = utf8(table.column("text"))
        data = LOWER[data]
        starts, ends, first = word_spans(data, at)
        n, counts = len(ids), np.diff(first)
        tokens = np.full(1 + len(starts) + n, END)
        tokens[0] = START
        tokens[1 + np.arange(len(starts)) + np.repeat(np.arange(n), counts)] = span_hashes(data, starts, ends)
        found = pa.array(tokens).dictionary_encode()
        hashes, places = found.dictionary.to_numpy(), found.indices.to_numpy()
        order = np.argsort(hashes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return cls(ids, counts + 1, hashes[order], rank[places[1:]])

    def pack(self) -> bytes:
        missing = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        return _squeeze(ids, missing, self.counts.astype("<i8"), _planes(np.diff(self.hashes, prepend=np.uint64(0)), 8), _planes(self.tokens, 4))

    @classmethod
    def unpack(cls, blob: bytes) -> Block:
        ids, missing, counts, hashes, planes = _expand(blob, "<i8", "u1", "<i8", "u1", "u1")
        return cls([None if m else i for i, m in zip(ids.tolist(), missing.tolist())], counts, np.cumsum(_integers(hashes, 8)), _integers(planes, 4).astype(np.int64))

    def before(self) -> np.ndarray:
        """The place of the hash before each token."""
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[np.cumsum(self.counts) - self.counts] = self.start
        return out

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the hashes in order of the bucket that counts them, and those buckets."""
        return _dealt((self.hashes >> np.uint64(16)) % np.uint64(buckets), buckets)

    def bigrams(self, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams in order of segment and context: 48 bits of the context, 32 of both, segment; each token's place."""
        n = len(self.hashes)
        pairs, place = np.unique(self.before() * n + self.tokens, return_inverse=True)
        context, token = self.hashes[pairs // n], self.hashes[pairs % n]
        with np.errstate(over="ignore"):
            both = mix(context * (M1 | np.uint64(1)) + token * (M2 | np.uint64(1))) >> np.uint64(32)
        order, segment = _dealt(both % np.uint64(segments), segments)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return context[order] >> np.uint64(16), both[order], segment, back[place]


def _dealt(to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by destination, of n, that keeps the order within each, and the destinations in that order."""
    order = np.argsort(to.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    return order, to[order].astype(np.int64)


def _read(buckets: int):
    """Of each block the block itself (kind 0), and its distinct tokens with their counts in training documents (kind 1)."""

    def run(batches):
        for number, table in in_blocks(batches, 1 << 14, 8_000_000):
            own = Block.read(table)
            counts = np.bincount(own.tokens[own.learned], minlength=len(own.hashes))
            counts[own.start] = (~own.held).sum()
            order, bucket = own.by_bucket(buckets)
            cuts = _cuts(bucket)
            rows = [(0, 0, number, own.pack())]
            rows += [(1, int(bucket[x]), number, _squeeze(_planes(np.diff(own.hashes[order[x:y]], prepend=np.uint64(0)), 8), _planes(counts[order[x:y]], 4))) for x, y in zip(cuts[:-1], cuts[1:])]
            yield _rows(rows, *_SENT)

    return run


def _blocks(batches):
    for batch in batches:
        for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
            yield number, Block.unpack(blob)


def _send_bigrams(segments: int):
    """Of each block the distinct bigrams, and how often its training documents have them."""

    def run(batches):
        for number, own in _blocks(batches):
            context, both, segment, place = own.bigrams(segments)
            counts = np.bincount(place[own.learned], minlength=len(context))
            rows, cuts = [], _cuts(segment)
            for x, y in zip(cuts[:-1], cuts[1:]):
                ends = _cuts(context[x:y])
                runs = context[x:y][ends[:-1]]
                blob = _squeeze(_planes(np.diff(runs, prepend=np.uint64(0)), 6), _planes(np.diff(ends), 4), _planes(both[x:y], 4), _planes(counts[x:y], 4))
                rows.append((2, int(segment[x]), number, blob))
            yield _rows(rows, *_SENT)

    return run


def probes_for(distinct: int) -> int:
    """So many probes that among ``distinct`` words a context has a false hit at most once in about 1,000 contexts.

    A key that is not in the filter passes k probes, 3 or more, with a probability of about 2 ** -(11 + 4.5 * k).
    """
    return max(3, -(-2 * int(distinct).bit_length() // 9))


class Segment:
    """A segment of the filter: a bigram of level q is entered with each level from 0 to q.

    An entry sets BITS bits in each word of its line, so that all its probes read neighbouring memory.
    """

    def __init__(self, key: np.ndarray, level: np.ndarray, probes: int):
        self.n = max(1, -(-int((level + 1).sum()) // LOAD))
        self.words = np.zeros((self.n, probes), np.uint64)
        for j in range(int(level.max(initial=-1)) + 1):
            entry = np.sort(_entry(key[level >= j], j))
            line = self._line(entry)
            begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, int)
            for probe, mask in enumerate(_probes(entry, probes)):
                self.words[line[begin], probe] |= np.bitwise_or.reduceat(mask, begin) if len(begin) else mask

    def _line(self, entry: np.ndarray) -> np.ndarray:
        return ((entry >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """One more than the level of each bigram, 0 where the segment lacks it: levels are probed upwards until one fails."""
        out, rows, level = np.zeros(len(key), np.uint8), np.arange(len(key)), 0
        while len(rows) and level < 64:
            entry = _entry(key[rows], level)
            line, hit = self._line(entry), np.ones(len(rows), bool)
            for probe, mask in enumerate(_probes(entry, self.words.shape[1])):
                hit &= self.words[line, probe] & mask == mask
            rows = rows[hit]
            level += 1
            out[rows] = level
        return out


def _entry(key: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key + np.uint64(level) * M1) if level else key


def _probes(entry: np.ndarray, n: int):
    """For each probe the bits that it tests."""
    for probe in range(n):
        if probe % 5 == 0:
            entry = mix(entry + M2)
        yield _MASKS[(entry >> np.uint64(12 * (probe % 5))) & np.uint64(len(_MASKS) - 1)]


def _key(context: np.ndarray, both: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * M2 + both)


def _count_bigrams(buckets: int, probes: int):
    """Of each segment: to each block the levels that the filter has for its bigrams (kind 3), and for each context the
    discounted counts of its bigrams, to the bucket of the context's word (kind 4).

    A bigram's level is the binary logarithm of its count in all training documents, rounded down.
    """

    def run(batches):
        for table, cuts in sorted_groups(batches, "bucket"):
            for x, y in zip(cuts[:-1], cuts[1:]):
                numbers, sizes, contexts, boths, counts = table.column("block")[x:y].to_pylist(), [], [], [], []
                for blob in table.column("blob")[x:y].to_pylist():
                    c, n, b, k = _expand(blob, "u1", "u1", "u1", "u1")
                    contexts.append(np.repeat(np.cumsum(_integers(c, 6)), _integers(n, 4).astype(np.int64)))
                    boths.append(_integers(b, 4))
                    counts.append(_integers(k, 4))
                    sizes.append(len(counts[-1]))
                context = np.concatenate(contexts)
                key, place = np.unique(_key(context, np.concatenate(boths)), return_inverse=True)
                total = np.bincount(place, np.concatenate(counts).astype(float), len(key))
                one = np.zeros(len(key), np.uint64)
                one[place] = context
                del contexts, boths, counts, context
                keep = total > 0
                level = np.floor(np.log2(total[keep])).astype(np.int64)
                found = Segment(key[keep], level, probes).levels(key)[place]
                segment = table.column("bucket")[int(x)].as_py()
                rows = [(3, segment, number, _squeeze(own)) for number, own in zip(numbers, np.split(found, np.cumsum(sizes)[:-1]))]
                own, at = np.unique(one[keep], return_inverse=True)
                mass = np.bincount(at, 2.0**level - DISCOUNT, len(own))
                order, to = _dealt(own % np.uint64(buckets), buckets)
                ends = _cuts(to)
                rows += [(4, int(to[s]), -1, _squeeze(_planes(np.diff(own[order[s:e]], prepend=np.uint64(0)), 6), mass[order[s:e]])) for s, e in zip(ends[:-1], ends[1:])]
                yield _rows(rows, *_SENT)

    return run


def _count_words(batches):
    """Of each bucket: to each block the counts of its words in all training documents, and the numbers of all of them."""
    for table, cuts in sorted_groups(batches, "bucket"):
        rows = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            sent = [(np.cumsum(_integers(h, 8)), _integers(n, 4)) for h, n in (_expand(blob, "u1", "u1") for blob in table.column("blob")[x:y].to_pylist())]
            words, place = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([s[1] for s in sent]).astype(float), len(words))
            real = (words != START) & (counts > 0)
            bucket, told = table.column("bucket")[int(x)].as_py(), np.split(counts[place], np.cumsum([len(s[0]) for s in sent])[:-1])
            for i, (number, own) in enumerate(zip(table.column("block")[x:y].to_pylist(), told)):
                rows.append((1, bucket, number, _squeeze(_planes(own, 8)), int(real.sum()) if not i else 0, int(counts[real].sum()) if not i else 0))
        yield _rows(rows, [*_SENT[0], "distinct", "total"], [*_SENT[1], pa.int64(), pa.int64()])


def _sum_masses(batches):
    """Of each bucket: to each block the masses of its words as contexts (kind 2)."""
    for table, cuts in sorted_groups(batches, "bucket"):
        rows = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            bucket, numbers, blobs = table.column("bucket")[int(x)].as_py(), table.column("block")[x:y].to_pylist(), table.column("blob")[x:y].to_pylist()
            told = [_expand(blob, "u1", "<f8") for number, blob in zip(numbers, blobs) if number < 0]
            if not told:
                continue
            context, place = np.unique(np.concatenate([np.cumsum(_integers(t[0], 6)) for t in told]), return_inverse=True)
            mass = np.bincount(place, np.concatenate([t[1] for t in told]), len(context))
            for number, blob in zip(numbers, blobs):
                if number >= 0:
                    own = np.cumsum(_integers(_expand(blob, "u1", "u1")[0], 8)) >> np.uint64(16)
                    at = np.minimum(np.searchsorted(context, own), len(context) - 1)
                    rows.append((2, bucket, number, _squeeze(np.where(context[at] == own, mass[at], 0.0))))
        yield _rows(rows, *_SENT)


def probability(level: np.ndarray, count: np.ndarray, mass: np.ndarray, base: np.ndarray) -> np.ndarray:
    """P(w | u) from the level of (u, w) plus one (0: not in the filter), c(u), M(u) and the unigram probability of w."""
    kept = np.where((level > 0) & (count > 0), 2.0 ** (level.astype(np.int64) - 1) - DISCOUNT, 0.0)
    return (kept + (count - mass + PRIOR) * base) / (count + PRIOR)


def _score(buckets: int, segments: int, total: int, distinct: int):
    def run(batches):
        for table, cuts in sorted_groups(batches, "block"):
            for x, y in zip(cuts[:-1], cuts[1:]):
                by: dict[int, list] = {0: [], 1: [], 2: [], 3: []}
                for row in table.slice(x, y - x).to_pylist():
                    by[row["kind"]].append((row["bucket"], row["blob"]))
                own = Block.unpack(by[0][0][1])
                order, bucket = own.by_bucket(buckets)
                counts, mass = np.zeros(len(order)), np.zeros(len(order))
                for to, kind, read in ((counts, 1, lambda b: _integers(_expand(b, "u1")[0], 8)), (mass, 2, lambda b: _expand(b, "<f8")[0])):
                    for k, blob in by[kind]:
                        s, e = np.searchsorted(bucket, [k, k + 1])
                        to[order[s:e]] = read(blob)
                _, _, _, place = own.bigrams(segments)
                level = np.concatenate([_expand(b, "u1")[0] for _, b in sorted(by[3])])[place]
                base = ((counts + 0.1) / (total + 0.1 * (distinct + 1)))[own.tokens]
                begin = np.cumsum(own.counts) - own.counts
                before = own.before()
                model = probability(level, counts[before], np.minimum(mass, counts)[before], base)
                columns = [
                    pa.array(own.ids, pa.int64()), pa.array(own.held), pa.array(own.counts), pa.array(np.add.reduceat((counts[own.tokens] > 0).astype(np.int64), begin)),
                    pa.array(np.full(len(begin), total)), pa.array(np.add.reduceat(np.log10(base), begin)), pa.array(np.add.reduceat(np.log10(model), begin)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Documents whose id as text has a crc32 that 10 divides are held out; the others train. Documents are read once into
    blocks of token numbers. Blocks send their distinct words and bigrams with counts to hashed buckets, so nothing is
    gathered by a frequent word. Word counts come back to the blocks exactly. All bigrams of training documents, those
    seen once too, enter the filter of their segment with the logarithm of their count; a segment answers the blocks'
    bigrams where it was built, so the filter follows the number of bigrams without a limit. There are so many segments
    that about ``room`` training tokens fall to one.

    score is the log10 probability under P(w | u) = (d(u, w) + (c(u) - M(u) + m) * base(w)) / (c(u) + m): d is the
    filter's count less a discount (0 outside the filter), M(u) the sum of d over the filter's bigrams of u, c(u) how
    often u is followed by a token, base the smoothed unigram of base_score, m a prior. Over the V known words and one
    word for all others it sums to 1, but for false hits of the filter, which probes_for makes rare however large V is.

    A null or empty text is one end token. Rows that repeat an id are separate documents; a null doc_id is held out. A
    very long text is scored whole, as a block of its own in one task. Extra columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    docs_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mass = docs_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, -(-mass // WORDS_ROOM))
    sent = stored(docs_.mapInArrow(_read(buckets), _SENT_SCHEMA), "coded", by="kind")
    columns = _SENT[0]
    packed, words = (sent.filter(F.col("kind") == k).select(*columns) for k in (0, 1))

    def dealt(df: DataFrame, by: str) -> DataFrame:
        return df.repartition(max(parts, mass // WORDS_ROOM), by).sortWithinPartitions(by)

    answers = stored(dealt(words, "bucket").mapInArrow(_count_words, _SENT_SCHEMA + ", distinct long, total long"), "words")
    distinct, total = (int(x or 0) for x in answers.agg(F.sum("distinct"), F.sum("total")).first())
    segments = max(parts, -(-total // room))
    bigrams = dealt(packed.mapInArrow(_send_bigrams(segments), _SENT_SCHEMA), "bucket")
    known = stored(bigrams.mapInArrow(_count_bigrams(buckets, probes_for(distinct)), _SENT_SCHEMA), "bigrams", by="kind")
    masses = dealt(known.filter("kind = 4").select(*columns).unionByName(words), "bucket").mapInArrow(_sum_masses, _SENT_SCHEMA)
    told = packed.unionByName(answers.select(*columns)).unionByName(masses).unionByName(known.filter("kind = 3").select(*columns))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt(told, "block").mapInArrow(_score(buckets, segments, total, distinct), schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
