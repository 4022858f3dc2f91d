"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The tokenizer file has a word-level BPE: NFC, white space runs to one space, lower case, a pattern that picks words,
bytes as printable characters, merges with an end-of-word mark. Frequent words with their ids are compiled into an
automaton that shares prefixes and suffixes; workers map it into memory, and merge the words that it lacks.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import LOWER, SPACE, slices, utf8, word_spans


_NONE = 1 << 60
#: Times that a few thousand documents must have a word to count it for the lexicon.
OFTEN = 3
#: Split as white space by Python but not by the tokenizer's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Below this, every code point is assigned.
_BEYOND = re.compile("[\u0378-\U0010ffff]")


class Model:
    """Merges of a tokenizer file, applied to one word at a time."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = [vocab[chars[b]] for b in range(256)]
        self.outer = [vocab[chars[b] + end] for b in range(256)]
        #: For a pair of ids: its rank above, the merged id in the lower 20 bits.
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[left] << 20 | vocab[right], rank << 20 | vocab[left + right])
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.spec = spec
        self._library = self._table = None

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: of all neighbouring pairs, the one of least rank is merged first, leftmost among equals."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.outer[word[-1]]
        if len(parts) > 64:
            return self._merge_long(parts)
        find = self.pairs.get
        scores = [find(x << 20 | y, _NONE) for x, y in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == _NONE:
                break
            i = scores.index(best)
            parts[i] = best & 0xFFFFF
            del parts[i + 1], scores[i]
            if i:
                scores[i - 1] = find(parts[i - 1] << 20 | parts[i], _NONE)
            if i < len(scores):
                scores[i] = find(parts[i] << 20 | parts[i + 1], _NONE)
        return parts

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words at once, as little-endian unsigned 32-bit integers: one merge for each word in a step."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (6, 10, 16, 32):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(rows), 20_000):
                own = rows[at : at + 20_000]
                ids, n = self._merge_rows([words[i] for i in own.tolist()], lengths[own], high)
                flat, ends = ids.astype("<u4")[np.arange(high) < n[:, None]].tobytes(), np.cumsum(n * 4).tolist()
                for i, x, y in zip(own.tolist(), [0, *ends[:-1]], ends):
                    out[i] = flat[x:y]
            low = high
        for i in np.flatnonzero(lengths > low).tolist():
            own = self.merge(words[i])
            out[i] = struct.pack(f"<{len(own)}I", *own)
        return out

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            self._table = PairTable(self.pairs)
            self._inner, self._outer = np.array(self.inner), np.array(self.outer)
        n, place = lengths.copy(), np.arange(width)
        ids = self._inner[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)]
        every = np.arange(len(words))
        last = np.fromiter((w[-1] for w in words), np.int64, len(words))
        ids[every, n - 1] = self._outer[last]
        score = np.full((len(words), width), _NONE)
        score[:, :-1] = np.where(place[:-1] < (n - 1)[:, None], self._table.find(ids[:, :-1] << 20 | ids[:, 1:]), _NONE)
        live, done, counts = every, np.zeros((len(words), width), np.int64), np.zeros(len(words), np.int64)
        while True:
            at = score.argmin(axis=1)
            best = score[np.arange(len(live)), at]
            over = best == _NONE
            if over.any():
                done[live[over]], counts[live[over]] = ids[over], n[over]
                stay = ~over
                live, ids, score, n, at, best = live[stay], ids[stay], score[stay], n[stay], at[stay], best[stay]
            if not len(live):
                return done, counts
            rows = np.arange(len(live))
            ids[rows, at] = best & 0xFFFFF
            after = place > at[:, None]
            shifted = np.concatenate([ids[:, 1:], ids[:, -1:]], axis=1)
            ids = np.where(after, shifted, ids)
            shifted = np.concatenate([score[:, 1:], np.full((len(live), 1), _NONE)], axis=1)
            score = np.where(after, shifted, score)
            n -= 1
            right, left = at < n - 1, at > 0
            score[rows, at] = np.where(right, self._table.find(ids[rows, at] << 20 | ids[rows, np.minimum(at + 1, width - 1)]), _NONE)
            before = np.maximum(at - 1, 0)
            score[rows[left], before[left]] = self._table.find(ids[rows, before] << 20 | ids[rows, at])[left]

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n, find = len(parts), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(s, i, parts[i], parts[i + 1]) for i in range(n - 1) if (s := find(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            score, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = score & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := find(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def unsure(self, text: str) -> bool:
        """Whether the text has code points that this Python's Unicode tables do not assign."""
        return _BEYOND.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))

    def by_library(self, text: str) -> list[int]:
        """Ids from the tokenizers library itself, whose Unicode tables may be newer."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(json.dumps(self.spec | {"truncation": None, "padding": None}))
        return self._library.encode(text, add_special_tokens=False).ids

    def chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[int]]:
        """What stands between white space in all texts, normalised: the distinct ones, which of them each is, and for
        each text the number before it. Texts that need another way have none here, and are listed."""
        normal, other = [], []
        for i, text in enumerate(texts):
            own = ""
            if not text.isascii() and self.unsure(text) or any(s in text for s in self.special):
                other.append(i)
            elif _ODD_SPACE.search(own := self.normal(text)):
                other.append(i)
                own = ""
            normal.append(own if own.isascii() else " ".join(own.split()))
        raw = [t.encode() for t in normal]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)])
        at[-1] = len(data)
        starts, ends, first = word_spans(data, at)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = pa.py_buffer(data[~SPACE[data]]) if len(data) else pa.py_buffer(b"")
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), flat]).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(), first, other

    def __reduce__(self):
        return Model, (self.spec,)


class PairTable:
    """Pairs to scores as arrays: an open-addressed table, probed for many pairs at once."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.scores = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        for key, score in pairs.items():
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.scores[slot] = key, score

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each pair's score, _NONE where it never merges."""
        with np.errstate(over="ignore"):
            slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.scores[slot], _NONE)
        open_ = np.nonzero((held != keys) & (held >= 0))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.scores[slot[tuple(x[hit] for x in open_)]]
            open_ = tuple(x[(held >= 0) & ~hit] for x in open_)
        return out


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, as bytes to map.

    States are merged bottom-up as sorted words pass, so equal suffixes are stored once. An arc carries how many words
    its earlier siblings lead to; summed along a path they number the words in order, and the number finds the ids.
    Arcs lie in one open-addressed table under their state and byte.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    ordered = sorted(words)

    def shrink(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = settle(node)

    for word in ordered:
        same = len(os.path.commonprefix([word, last]))
        shrink(same)
        path += [[False, {}] for _ in word[same:]]
        path[-1][0] = True
        last = word
    shrink(0)
    root = settle(path[0])

    counts = [0] * len(states)
    for i, (final, arcs) in enumerate(states):  # targets come before their sources
        counts[i] = final + sum(counts[t] for _, t in arcs)
    size = 1 << max(4, (2 * sum(len(arcs) for _, arcs in states)).bit_length())
    keys, target, skip = [-1] * size, [0] * size, [0] * size
    for i, (final, arcs) in enumerate(states):
        number = int(final)
        for byte, to in arcs:
            slot = _slot(i << 8 | byte, size)
            while keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            keys[slot], target[slot], skip[slot] = i << 8 | byte, to, number
            number += counts[to]
    final = np.array([f for f, _ in states], np.int32)
    lengths = [len(words[w]) for w in ordered]
    begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    ids = np.array([i for w in ordered for i in words[w]], np.int32)
    head = struct.pack("<5i", root, len(final), size, len(begin), len(ids))
    return head + b"".join(np.asarray(x, "<i4").tobytes() for x in (final, keys, target, skip, begin, ids))


def _slot(key: int, size: int) -> int:
    return (key * 0x9E3779B1 >> 7) & (size - 1)


class Lexicon:
    """A compiled automaton, mapped from a file of the worker's own temporary folder that has no name any more."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, n_states, self.size, n_begin, n_ids = struct.unpack("<5i", self._map[:20])
        at, parts = 20, []
        for n in (n_states, self.size, self.size, self.size, n_begin, n_ids):
            parts.append(np.frombuffer(self._map, "<i4", n, at))
            at += 4 * n
        self.final, self.keys, self.target, self.skip, self.begin, self.ids = parts

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The words' ids as little-endian unsigned 32-bit integers, None where the lexicon lacks one: all walk on together."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        text, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        state, number, live = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words))
        for step in range(int(n.max(initial=0))):
            live = live[n[live] > step]
            key = state[live] << 8 | text[at[live] + step]
            slot = (key.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) & (self.size - 1)
            held = self.keys[slot]
            while len(off := np.flatnonzero((held != key) & (held >= 0))):
                slot[off] = (slot[off] + 1) & (self.size - 1)
                held[off] = self.keys[slot[off]]
            state[live[held < 0]] = -1
            live, slot = live[held >= 0], slot[held >= 0]
            number[live] += self.skip[slot]
            state[live] = self.target[slot]
        hit = (state >= 0) & (self.final[state] > 0)
        number = np.where(hit, number, 0)
        return [self.ids[x:y].tobytes() if h else None for h, x, y in zip(hit.tolist(), self.begin[number].tolist(), self.begin[np.minimum(number + 1, len(self.begin) - 1)].tolist())]


class Encoder:
    """Whole texts to ids, by way of a bounded memo of words and of what else stands between white space.

    A full memo becomes the old one, from which what is still used comes back. Words come from the automaton, or are
    merged where it lacks them.
    """

    def __init__(self, model: Model, lexicon: Lexicon, most: int = 300_000):
        self.model, self.lexicon, self.most = model, lexicon, most
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _remember(self, keys: list[bytes], values: list[bytes]) -> None:
        if len(self.memo) >= self.most:
            self.old, self.memo = self.memo, {}
        self.memo.update((k, v) for k, v in zip(keys, values) if len(k) <= 64)

    def _known(self, keys: list[bytes]) -> tuple[list[bytes | None], list[int]]:
        """What the memo has for each key, and where it has nothing."""
        found = list(map(self.memo.get, keys))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking and self.old:
            back = [i for i in lacking if keys[i] in self.old]
            for i in back:
                found[i] = self.old[keys[i]]
            self._remember([keys[i] for i in back], [found[i] for i in back])
            lacking = [i for i in lacking if found[i] is None]
        return found, lacking

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, as the model picks them."""
        found, lacking = self._known(words)
        for i, ids in zip(lacking, self.lexicon.find([words[i] for i in lacking])):
            found[i] = ids
        unseen = [i for i in lacking if found[i] is None]
        for i, ids in zip(unseen, self.model.merge_many([words[i] for i in unseen])):
            found[i] = ids
        self._remember([words[i] for i in lacking], [found[i] for i in lacking])
        return found

    def look_up(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks; all their words that are new are found or merged together."""
        found, lacking = self._known(chunks)
        simple = [i for i in lacking if chunks[i].isalpha()]  # one word, as its bytes are ASCII letters
        for i, ids in zip(simple, self._words([chunks[i] for i in simple])):
            found[i] = ids
        mixed = [i for i in lacking if found[i] is None]
        pick = self.model.words.findall
        parts = [[chunks[i]] if (t := chunks[i].decode("utf-8", "surrogatepass")).isalpha() else [w.encode("utf-8", "surrogatepass") for w in pick(t)] for i in mixed]
        words = list({w for own in parts for w in own})
        get = dict(zip(words, self._words(words))).__getitem__
        for i, own in zip(mixed, parts):
            found[i] = b"".join(map(get, own))
        self._remember([chunks[i] for i in mixed], [found[i] for i in mixed])
        return found

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and for each text the number before it."""
        distinct, codes, first, other = self.model.chunks(texts)
        found = self.look_up(distinct.to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        begin = np.cumsum(lengths, dtype=np.int32) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        place = np.repeat((begin[codes] - (ends - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        out = ids[place]
        bounds = np.append(0, ends)[first]
        if not other:
            return out, bounds
        pieces = [out[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        for i in other:
            pieces[i] = np.frombuffer(self.encode(texts[i]), "<u4")
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers; special tokens in the text keep their own ids."""
        model = self.model
        if not text.isascii() and model.unsure(text):
            ids = model.by_library(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        if not any(s in text for s in model.special):
            normal = model.normal(text)
            parts = model.words.findall(normal) if _ODD_SPACE.search(normal) else normal.split()
            parts = [x.encode("utf-8", "surrogatepass") for x in parts]
            distinct = list(dict.fromkeys(parts))
            return b"".join(map(dict(zip(distinct, self.look_up(distinct))).__getitem__, parts))
        out, at = [], 0
        for m in model.split.finditer(text):
            out += [self.encode(text[at : m.start()]), struct.pack("<I", model.special[m.group()])]
            at = m.end()
        return b"".join([*out, self.encode(text[at:])])


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def frequent_words(docs: DataFrame, model: Model, most: int) -> list[bytes]:
    """The words that most often stand between white space in all documents, ``most`` at most, by their bytes with A-Z in lower case.

    Every few thousand documents send the words that they have OFTEN times or more, with their counts, which are added up.
    """

    def run(batches):
        for part in itertools.chain.from_iterable(map(slices, batches)):
            data, at = utf8(part.column("text"))
            data = LOWER[data]
            starts, ends, _ = word_spans(data, at)
            offsets = np.concatenate([[0], np.cumsum(ends - starts)])
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACE[data]])]).dictionary_encode()
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            top = np.flatnonzero(counts >= OFTEN)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(top)).cast(pa.binary()), pa.array(counts[top], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word binary, n long").filter(F.length("word") <= 64).groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("word").cast("string").rlike(r"^\p{L}+$")).orderBy(F.desc("n"), "word").limit(most).select("word").collect()
    return [w for w in (bytes(r.word) for r in top) if w.decode().isalpha()]


def encoder_parts(docs: DataFrame, path: str, most: int = 30_000) -> tuple[str, Model, bytes]:
    """A name, the model and the compiled lexicon, for a broadcast: the vocabulary's fixed size and at most ``most`` words.

    Which words are compiled decides the speed only, never which ids a text gets.
    """
    model = Model(read_spec(path))
    words = frequent_words(docs, model, most)
    return uuid.uuid4().hex, model, compile_lexicon({w: model.merge(w) for w in words})


_HELD: dict[str, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The Python worker's encoder of a broadcast from encoder_parts; one is kept."""
    name, model, lexicon = shared.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Encoder(model, Lexicon(lexicon))
    return _HELD[name]


class Decoder:
    """What a tokenizer without a decoder gives for ids: the tokens joined by spaces."""

    def __init__(self, tokens: dict[int, str]):
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_string())

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """The texts of ids[begin[i] : begin[i + 1]]."""
        lists = pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): the ids of each whole text (packed 32-bit) and the text they decode to.

    A null or empty text has no ids and decodes to an empty text. A very long text is encoded whole, in one task's
    memory. Every row gives a row, repeated and null ids included; extra columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder_parts(docs, path))

    def run(batches):
        encoder = worker_encoder(shared)
        decoder = Decoder(encoder.model.tokens)
        for batch in batches:
            for part in slices(batch):
                ids, begin = encoder.encode_many([t or "" for t in part.column("text").to_pylist()])
                raw = ids.tobytes()
                packed = pa.array([raw[4 * x : 4 * y] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary())
                columns = [part.column("doc_id"), pa.array(np.diff(begin), pa.int64()), packed, decoder.decode(ids, begin).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
