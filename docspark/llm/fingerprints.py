"""Document fingerprints: an invertible Bloom lookup sketch of a text's paragraphs, and what differs between versions."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import M1, M2, mix, pack, partitions, sorted_groups, span_hashes, unpack, utf8, word_spans

#: Cells of the fingerprint, growth of a failed comparison's sketch, a paragraph's mean length in words within a line.
CELLS, GROWTH, MEAN_WORDS = 24, 4, 8
#: Bytes of text to a range of ids on average, which a task holds at once.
RANGE = 1 << 25
_LEAST = np.iinfo(np.int64).min


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit digests of each text's paragraphs, and for each text the number before it.

    A paragraph ends with its line, or after a word whose hash MEAN_WORDS divides, so an edit changes few of them. A
    paragraph's digest takes its words in order and how often it stood in the text before, so repeats count.
    """
    data, at = utf8(texts)
    starts, ends, first = word_spans(data, at)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    words = span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    breaks = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(n, bool)
    new[1:] = (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1]) | (words[:-1] % np.uint64(MEAN_WORDS) == 0)
    begin = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    with np.errstate(over="ignore"):
        own = mix(np.add.reduceat(words * (mix(place.astype(np.uint64) * M2 + M1) | np.uint64(1)), begin))
        of = text[begin]
        order = np.lexsort((own, of))
        same = np.zeros(len(own), bool)
        same[1:] = (own[order][1:] == own[order][:-1]) & (of[order][1:] == of[order][:-1])
        group = np.flatnonzero(~same)
        nth = np.arange(len(own)) - np.repeat(group, np.diff(np.append(group, len(own))))
        out = mix(own[order] + nth.astype(np.uint64) * M1)
    return out, np.searchsorted(of[order], np.arange(len(at)))


class Sketches:
    """Lookup sketches of many sets: for each cell a count and exclusive-ors of its digests and of their checks."""

    def __init__(self, n: int, cells: int):
        self.third = cells // 3
        self.count = np.zeros((n, 3 * self.third), np.int32)
        self.digest = np.zeros((n, 3 * self.third), np.uint64)
        self.check = np.zeros((n, 3 * self.third), np.uint32)

    def add(self, rows: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Put digests into three cells each, or take them out where the sign is negative."""
        width, checks = 3 * self.third, _check(keys)
        for j in range(3):
            with np.errstate(over="ignore"):
                spot = mix(keys + np.uint64(j + 1) * M2) % np.uint64(self.third)
            at = rows * width + j * self.third + spot.astype(np.int64)
            np.add.at(self.count.ravel(), at, sign)
            np.bitwise_xor.at(self.digest.ravel(), at, keys)
            np.bitwise_xor.at(self.check.ravel(), at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, 3 * self.third)
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the differences hold: rows, digests and signs, and which rows came out whole. Empties the sketches."""
        found = []
        width = 3 * self.third
        for _ in range(4 * width + 64):
            row, cell = np.nonzero(np.abs(self.count) == 1)
            keys = self.digest[row, cell]
            pure = (self.check[row, cell] == _check(keys)) & (keys != 0)
            row, cell, keys = row[pure], cell[pure], keys[pure]
            if not len(row):
                break
            order = np.lexsort((keys, row))
            row, keys, sign = row[order], keys[order], self.count[row, cell][order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            row, keys, sign = row[once], keys[once], sign[once]
            found.append((row, keys, sign))
            self.add(row, keys, -sign)
        whole = (self.count == 0).all(axis=1) & (self.digest == 0).all(axis=1) & (self.check == 0).all(axis=1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), whole
        return (*(np.concatenate(c) for c in zip(*found)), whole)

    def texts(self) -> list[str]:
        cells = np.concatenate([self.count.astype("<i4").view(np.uint8), self.digest.astype("<u8").view(np.uint8), self.check.astype("<u4").view(np.uint8)], axis=1)
        return [base64.b64encode(row.tobytes()).decode() for row in cells]


def _check(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys * M1 + M2) >> np.uint64(32)).astype(np.uint32)


def sketches(keys: np.ndarray, first: np.ndarray, cells: int) -> Sketches:
    out = Sketches(len(first) - 1, cells)
    out.add(np.repeat(np.arange(len(first) - 1), np.diff(first)), keys)
    return out


def _some(keys: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[rows]
    begin = np.concatenate([[0], np.cumsum(n)])
    return keys[np.arange(begin[-1]) + np.repeat(first[rows] - begin[:-1], n)], begin


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Common paragraphs against all paragraphs of two versions, row by row (1 where both have none).

    The sketches are subtracted and peeled; what doesn't come out whole is tried again with GROWTH times the cells.
    """
    na, nb = np.diff(a[1]), np.diff(b[1])
    out = np.ones(len(na))
    open_ = np.arange(len(na))
    while len(open_):
        failed = []
        step = max(1, (1 << 18) // cells)
        for at in range(0, len(open_), step):
            rows = open_[at : at + step]
            row, _, sign, whole = sketches(*_some(*a, rows), cells).minus(sketches(*_some(*b, rows), cells)).peel()
            gone = np.bincount(row[sign > 0], minlength=len(rows))
            common = na[rows] - gone
            all_ = na[rows] + nb[rows] - common
            whole &= (common >= 0) & (nb[rows] - np.bincount(row[sign < 0], minlength=len(rows)) == common)
            out[rows[whole]] = np.where(all_[whole] > 0, common[whole] / np.maximum(all_[whole], 1), 1.0)
            failed.append(rows[~whole])
        open_ = np.concatenate(failed)
        cells *= GROWTH
    return out


def _deal(bounds: np.ndarray, least: int):
    """Documents to the ranges of their ids, packed; the first of a range also to the range before, as a guest."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            bucket = np.searchsorted(bounds, keys, "right")
            guest = np.flatnonzero(np.isin(keys, bounds))
            last = np.flatnonzero(keys == least)
            rows = np.concatenate([np.arange(len(keys)), guest, last])
            to = np.concatenate([bucket, bucket[guest] - 1, np.full(len(last), len(bounds))])
            host = np.arange(len(rows)) < len(keys)
            order = np.argsort(to, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(to[order]) != 0)), len(order)) if len(order) else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                own = order[x:y]
                part = pa.Table.from_batches([batch.take(pa.array(rows[own]))]).append_column("host", pa.array(host[own]))
                yield pa.RecordBatch.from_arrays([pa.array([int(to[own[0]])], pa.int64()), pa.array([pack(part.combine_chunks())], pa.binary())], ["bucket", "blob"])

    return run


def _versions(batches):
    for table, cuts in sorted_groups(batches, "bucket"):
        for x, y in zip(cuts[:-1], cuts[1:]):
            part = pa.concat_tables([unpack(b) for b in table.column("blob")[x:y].to_pylist()])
            keys, texts = part.column("key").to_pylist(), part.column("text").to_pylist()
            hosts, ids = part.column("host").to_pylist(), part.column("doc_id").to_pylist()
            own = sorted((keys[i], texts[i] or "", i) for i in range(len(keys)) if hosts[i])
            guests = sorted((keys[i], texts[i] or "") for i in range(len(keys)) if not hosts[i])
            own_texts = [t for _, t, _ in own]
            after = own_texts[1:] + [guests[0][1]]
            for at in range(0, len(own), 2000):
                chunk, then = own_texts[at : at + 2000], after[at : at + 2000]
                edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(chunk, then)]
                a, b, c = (digests(pa.array(v, pa.large_string())) for v in (chunk, edited, then))
                columns = [
                    pa.array([ids[i] for _, _, i in own[at : at + 2000]], part.schema.field("doc_id").type), pa.array([len(t) for t in chunk], pa.int64()), pa.array(edited, pa.string()),
                    pa.array(sketches(*a, CELLS).texts()), pa.array(sketches(*b, CELLS).texts()), pa.array(likeness(a, b)), pa.array(likeness(a, c)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one per document.

    The edited version has the last quarter of the code points replaced by the first as many of the next document (by
    ascending doc_id, then text; after the last comes the first). A fingerprint is the base64 form of CELLS cells;
    near_edited and near_next are the shares of paragraphs in common that comparing sketches recovers.

    Documents are dealt to ranges of doc_id whose bounds are quantiles, as compressed blocks, and the first document
    of a range is also sent to the range before, so neighbours meet without a global order in one task.

    A null or empty text has no paragraphs; a null doc_id comes before all others; rows that repeat an id follow each
    other by text. A very long text is sketched whole, with the range that holds it in one task's memory. Extra columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), "text")
    mass = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * partitions(spark), mass // RANGE)
    found = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("at"), F.min("key").alias("least")).first()
    bounds = np.unique(np.array([b for b in found["at"] or [] if b > found["least"]], np.int64))
    least = found["least"] if found["least"] is not None else 0
    dealt = keyed.mapInArrow(_deal(bounds, least), "bucket long, blob binary").repartition(max(partitions(spark), n // 8), "bucket").sortWithinPartitions("bucket")
    schema = f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_versions, schema)
