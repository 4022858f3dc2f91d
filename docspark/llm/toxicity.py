"""Toxicity by classifier chains: linear models in sequence, each fed the earlier categories' probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import LOWER, M1, mix, span_hashes, stored, utf8

#: Prefix lengths that are features beside the whole word (0), features of a model, folds, ridge penalty.
PREFIXES, FEATURES, FOLDS, RIDGE = (0, 4, 5, 6), 256, 5, 1.0
#: Features of the sample that the driver gets for each category, those whose log odds differ most surely.
LIKELY = 2048
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (runs of letters, A-Z in lower case) and of their prefixes; the text of each."""
    data, at = utf8(texts)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    ink = _LETTER[data]
    begin, end = ink.copy(), ink.copy()
    if len(data):
        begin[1:] &= ~ink[:-1] | edge[1:-1]
        end[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    text = np.searchsorted(at, starts, "right") - 1
    data = LOWER[data]
    keys, of = [], []
    with np.errstate(over="ignore"):
        for n in PREFIXES:
            rows = slice(None) if not n else ends - starts > n
            own = span_hashes(data, starts[rows], np.minimum(ends[rows], starts[rows] + n) if n else ends)
            keys.append(mix(own + np.uint64(n + 1) * M1))
            of.append(text[rows])
    return np.concatenate(keys), np.concatenate(of)


def _distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], of[new]


@dataclass
class Linear:
    """A logistic model on the presence of some features and on the probabilities of earlier categories."""

    keys: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, keys: np.ndarray, of: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias) + earlier @ self.earlier
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            pairs = np.unique(of[hit].astype(np.int64) * len(self.keys) + at[hit])
            out += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], n)
        return out


def fit(found: np.ndarray, codes: np.ndarray, of: np.ndarray, label: np.ndarray, earlier: np.ndarray) -> Linear:
    """A model from features found[codes] of documents ``of``. Choose the features whose log odds differ most surely between the classes, then fit with a ridge penalty."""
    n, yes = len(label), int(label.sum())
    if not 0 < yes < n:
        rate = (yes + 0.5) / (n + 2)  # a quarter, where nothing is known
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    a = np.bincount(codes[label[of] > 0], minlength=len(found)).astype(float)
    b = np.bincount(codes, minlength=len(found)) - a
    odds = np.log((a + 0.5) / (yes - a + 0.5)) - np.log((b + 0.5) / (n - yes - b + 0.5))
    sure = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (yes - a + 0.5) + 1 / (b + 0.5) + 1 / (n - yes - b + 0.5))
    sure[a + b < 4] = 0
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    chosen = chosen[sure[chosen] > 2]
    place = np.full(len(found), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    hit = place[codes] >= 0
    x = np.zeros((n, len(chosen) + earlier.shape[1] + 1))
    x[of[hit], place[codes[hit]]] = 1
    x[:, len(chosen) : -1] = earlier
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (label - p) - penalty * w)
        w += move * min(1.0, 4.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return Linear(found[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def fit_chain(found: np.ndarray, codes: np.ndarray, of: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """One model for each column of labels, in order; a model learns from out-of-fold probabilities of the earlier ones.

    Document of[i] has the feature found[codes[i]].
    """
    n = len(labels)
    fold = np.arange(n) % FOLDS
    earlier = np.zeros((n, 0))
    chain = []
    for j in range(labels.shape[1]):
        label = labels[:, j].astype(float)
        outside = np.zeros(n)
        for k in range(FOLDS):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if not len(train) or not len(test):
                continue
            to = np.full(n, -1)
            to[train] = np.arange(len(train))
            rows = to[of] >= 0
            model = fit(found, codes[rows], to[of[rows]], label[train], earlier[train])
            to = np.full(n, -1)
            to[test] = np.arange(len(test))
            rows = to[of] >= 0
            outside[test] = model.logits(found[codes[rows]], to[of[rows]], len(test), earlier[test])
        chain.append(fit(found, codes, of, label, earlier))
        earlier = np.column_stack([earlier, _probability(outside)])
    return chain


def predict(chain: list[Linear], texts: pa.Array) -> np.ndarray:
    """Probabilities [text, category]."""
    keys, of = features(texts)
    out = np.zeros((len(texts), 0))
    for model in chain:
        out = np.column_stack([out, _probability(model.logits(keys, of, len(texts), out))])
    return out


def _probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -20, 20)))


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = 8000) -> list[Linear]:
    """The chain from at most about ``most`` labelled documents, picked by a hash of doc_id.

    Categories are columns of labels, in the order of the chain; a null label counts as no. A doc_id with several rows
    of labels has a category if one row says so.
    """
    own = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c.cast("int")).alias(f"label_{i}") for i, c in enumerate(categories.values())])
    share = min(1.0, most / max(1, own.count()))
    some = own.filter(F.pmod(F.xxhash64("doc_id", F.lit("chain")), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("doc_id", F.lit("chain")), "doc_id").limit(2 * most)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, of = _distinct(*features(part.column("text")))
                begin = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), lists], [*(c for c in part.schema.names if c != "text"), "keys"])

    named = [f"label_{i}" for i in range(len(categories))]
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", *named, "text")
    labelled = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} int" for c in named)
    sample = stored(sample.mapInArrow(run, f"{labelled}, keys array<long>"), "sample")
    n, *yes = sample.agg(F.count(F.lit(1)), *[F.sum(F.coalesce(c, F.lit(0))) for c in named]).first()

    def count(batches):
        for batch in batches:
            lists = batch.column("keys")
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            keys, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            held = [np.bincount(place, (batch.column(c).fill_null(0).to_numpy() > 0)[of], len(keys)).astype(np.int64) for c in named]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(place, minlength=len(keys))), *map(pa.array, held)], ["key", "n", *named])

    counts = sample.mapInArrow(count, "key long, n long, " + ", ".join(f"{c} long" for c in named)).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *named)]).filter("n >= 4")
    counts = stored(counts, "features")
    likely: set[int] = set()
    for c, own in zip(named, yes):
        a, b, y, z = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5, F.lit(float(own or 0)) - F.col(c) + 0.5, F.lit(float(n - (own or 0))) - F.col("n") + F.col(c) + 0.5
        sure = F.abs(F.log(a / y) - F.log(b / z)) / F.sqrt(1 / a + 1 / b + 1 / y + 1 / z)
        likely.update(r.key for r in counts.orderBy(F.desc(sure), "key").limit(LIKELY).select("key").collect())
    found = np.sort(np.array(list(likely), np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def pick(batches):
        known = shared.value
        for batch in batches:
            lists = batch.column("keys")
            keys, of = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            begin = np.searchsorted(of[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(begin), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "keys"), codes], [*(c for c in batch.schema.names if c != "keys"), "codes"])

    rows = sample.mapInArrow(pick, f"{labelled}, codes array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return fit_chain(found.view(np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(named))))
    lists = rows.column("codes").combine_chunks()
    of = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
    order = np.argsort(found.view(np.uint64))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return fit_chain(found.view(np.uint64)[order], rank[lists.flatten().to_numpy()], of, np.column_stack([rows.column(c).fill_null(0).to_numpy() for c in named]))


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = 8000) -> DataFrame:
    """docs with a column p_<category> for each category: its probability for the whole text.

    The chain learns from a bounded sample of the labelled documents. The models (a bounded number of weights) are broadcast; documents are scored where they lie, with no shuffle. A
    null or empty text has no features; a very long text is scored whole. Every row gives a row, repeated and null ids
    too; all columns of docs stay, but one named like a new one gives way to it. Without labels
    a probability is a quarter; where a category has one class only, it is near the base rate. An empty table gives an empty result.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train_chain(docs, labels, categories, most))
    names = [f"p_{c}" for c in categories]
    docs = docs.drop(*names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                p = predict(chain.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, i]) for i in range(p.shape[1]))], [*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.DoubleType()) for name in names)])
    return docs.mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The chain over the table ``labels``: poor quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
