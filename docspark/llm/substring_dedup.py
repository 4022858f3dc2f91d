"""Substring dedup by super-k-mers: windows that share a minimiser travel together, and a bucket sorts them exactly."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import M1, M2, blocks, mix, pack, partitions, sorted_groups, span_hashes, unpack, word_spans

#: Words of the runs of which the least hash is a window's minimiser.
MINIMISER = 3
#: Bytes of text to a bucket on average, whose strings a task holds at once.
BUCKET = 1 << 23
_LAST = np.iinfo(np.int64).max


def _bytes_and_starts(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(strings), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    at[-1] = len(data)
    return data, at


def _windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and for each string the number of windows before it."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts), begin


class Runs:
    """A block's documents in order of id, and its runs of consecutive windows with the same minimiser."""

    def __init__(self, table: pa.Table, size: int):
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: _LAST if ids[i] is None else ids[i])
        self.ids = [ids[i] for i in order]
        self.sort = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        texts = table.column("text").cast(pa.large_binary()).to_pylist()
        self.texts = [b" ".join((texts[i] or b"").split()) for i in order]
        data, at = _bytes_and_starts(self.texts)
        starts, ends, self.first = word_spans(data, at)
        words = span_hashes(data, starts, ends)
        self.windows, begin = _windows(self.first, size)
        doc = np.repeat(np.arange(len(order)), np.diff(begin))
        n = len(words)
        with np.errstate(over="ignore"):
            least = np.zeros(n, np.uint64)
            if n >= MINIMISER:
                least[: n - 2] = mix(words[: n - 2] + words[1 : n - 1] * (M1 | np.uint64(1)) + words[2:] * (M2 | np.uint64(1)))
        span, width = 1, size - MINIMISER + 1
        while 2 * span <= width:
            least[:-span] = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span and n > width - span:
            least[: -(width - span)] = np.minimum(least[: -(width - span)], least[width - span :])
        least = least[self.windows]
        new = np.ones(len(self.windows), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        self.begin = np.append(np.flatnonzero(new), len(new))
        at = self.begin[:-1]
        self.doc, self.minimiser = doc[at], least[at]
        text, last = data.tobytes(), self.windows[self.begin[1:] - 1] + size - 1
        strings = [text[s:e] for s, e in zip(starts[self.windows[at]].tolist(), ends[last].tolist())]
        index: dict[bytes, int] = {}
        self.string = np.fromiter((index.setdefault(s, len(index)) for s in strings), np.int64, len(strings))
        self.strings = list(index)
        fresh = np.ones(len(strings), bool)
        if len(strings):
            fresh[1:] = self.string[1:] > np.maximum.accumulate(self.string)[:-1]
        self.origin = np.flatnonzero(fresh)  # of each distinct string, the run of its least document
        self.counts = np.diff(self.begin)[self.origin]


def _send(size: int, buckets: int):
    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
                runs = Runs(unpack(blob), size)
                bucket = (runs.minimiser[runs.origin] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order)) if len(order) else [0]
                rows = []
                for x, y in zip(cuts[:-1], cuts[1:]):
                    own = order[x:y]
                    sent = pa.table({"at": pa.array(own), "doc": pa.array(runs.sort[runs.doc[runs.origin[own]]]), "string": pa.array([runs.strings[i] for i in own.tolist()], pa.binary())})
                    rows.append((int(bucket[own[0]]), block, pack(sent, 6)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["bucket", "block", "blob"])

    return run


def _count(size: int):
    """In a bucket: sort all windows; where a window is in a smaller document than its string's, say so to the block."""

    def run(batches):
        factors = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * M1) | np.uint64(1)
        for table, cuts in sorted_groups(batches, "bucket"):
            rows = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                blocks_ = table.column("block")[x:y].to_pylist()
                sent = [unpack(b) for b in table.column("blob")[x:y].to_pylist()]
                lengths = [t.num_rows for t in sent]
                data, at = _bytes_and_starts([s for t in sent for s in t.column("string").to_pylist()])
                starts, ends, first = word_spans(data, at)
                words = span_hashes(data, starts, ends)
                windows, begin = _windows(first, size)
                docs = np.concatenate([t.column("doc").to_numpy() for t in sent])
                doc = np.repeat(docs, np.diff(begin))
                key, check = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(size):
                        word = words[windows + j]
                        key += word * factors[j]
                        check += mix(word + factors[size + j])
                        check *= M1
                order = np.argsort(key, kind="stable")
                key, check = key[order], check[order]
                new = np.ones(len(order), bool)
                new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
                least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
                back = np.empty(len(order), np.int64)
                back[order] = np.repeat(least, np.diff(np.append(np.flatnonzero(new), len(order))))
                told = np.add.reduceat((back < doc).astype(np.int64), begin[:-1]) > 0
                edge = np.concatenate([[0], np.cumsum(lengths)])
                for k, t in enumerate(sent):
                    own = np.flatnonzero(told[edge[k] : edge[k + 1]])
                    if len(own):
                        spans = [back[begin[i] : begin[i + 1]] for i in (own + edge[k]).tolist()]
                        flat = np.concatenate(spans)
                        ends_ = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
                        answer = pa.table({"at": t.column("at").take(pa.array(own)), "least": pa.ListArray.from_arrays(pa.array(ends_), pa.array(flat))})
                        rows.append((blocks_[k], 1, pack(answer)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["block", "kind", "blob"])

    return run


def _remove(size: int, kind: pa.DataType):
    def run(batches):
        for table, cuts in sorted_groups(batches, "block"):
            kinds, blobs = table.column("kind").to_pylist(), table.column("blob")
            for x, y in zip(cuts[:-1], cuts[1:]):
                runs = Runs(unpack(blobs[next(i for i in range(x, y) if kinds[i] == 0)].as_py()), size)
                offset = np.concatenate([[0], np.cumsum(runs.counts)])
                least = np.repeat(runs.sort[runs.doc[runs.origin]], runs.counts)
                for i in range(x, y):
                    if kinds[i]:
                        answer = unpack(blobs[i].as_py())
                        at, spans = answer.column("at").to_numpy(), answer.column("least").combine_chunks()
                        n = np.diff(spans.offsets.to_numpy())
                        into = np.arange(n.sum()) + np.repeat(offset[at] - (np.cumsum(n) - n), n)
                        least[into] = spans.values.to_numpy()
                n = np.diff(runs.begin)
                own = np.arange(len(runs.windows)) + np.repeat(offset[runs.string] - runs.begin[:-1], n)
                gone = runs.windows[least[own] < np.repeat(runs.sort[runs.doc], n)]
                cover = np.zeros(runs.first[-1] + size + 1, np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + size, -1)
                stay = np.cumsum(cover)[: runs.first[-1]] == 0
                rows = []
                for i, text in enumerate(runs.texts):
                    mask = stay[runs.first[i] : runs.first[i + 1]]
                    kept = text if mask.all() else b" ".join(compress(text.split(), mask.tolist()))
                    rows.append((runs.ids[i], len(mask), int(len(mask) - mask.sum()), kept))
                for at in range(0, len(rows), 1000):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000]), (kind, pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def drop_repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): words covered by a window that a document of smaller id has go.

    Words are runs without ASCII white space, unchanged; a window is ``window`` words in a row. Documents are packed
    into blocks. A block sends each distinct run of consecutive windows with one minimiser as one packed string, with
    the least doc_id that holds it there, to the minimiser's bucket, so a passage of many documents arrives once from
    each block. A bucket sorts the windows by their hashes, finds each window's least doc_id, and answers blocks
    whose documents are larger. Blocks then mark and remove; windows are judged on the input.

    A null or empty text has no words and keeps an empty text. A very long text is taken whole, as a block of its own.
    Rows that share a doc_id do not remove each other's words; a null doc_id counts as the largest. Kept words are
    joined by one space. Extra columns are ignored, whatever their names; an empty table gives an empty result. Windows
    are told apart by two mixes of the 64-bit hashes of their words, words by those hashes.
    """
    kind = docs.schema["doc_id"].dataType
    packed = blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    mass = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(partitions(docs.sparkSession), mass // (1 << 27))
    buckets = max(4 * tasks, mass // BUCKET)
    sent = packed.mapInArrow(_send(window, buckets), "bucket long, block long, blob binary")
    sent = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    answers = sent.mapInArrow(_count(window), "block long, kind int, blob binary")
    both = packed.select("block", F.lit(0).alias("kind"), "blob").unionByName(answers)
    both = both.repartition(tasks, "block").sortWithinPartitions("block")
    out = both.mapInArrow(_remove(window, pa.int64()), "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
