"""Embedding near-dedup by lattice hashing: random projections decoded to E8 points, neighbouring cells probed."""

from __future__ import annotations

import hashlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import M1, M2, components, mix, sorted_groups, stored

#: Hash tables, neighbouring cells probed in each, cell width against unit vectors, members of a bucket in one task.
TABLES, PROBES, SCALE, GROUP = 8, 6, 0.85, 1024


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for x, y in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = x, y
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: where the sum is odd, the worst coordinate rounds the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the even integer points and the same shifted by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def projections(width: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(TABLES, width, 8)) / SCALE


def cells(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For unit vectors the buckets [row, table, 1 + PROBES]: of the own cell and of the neighbours that are nearest."""
    out = np.zeros((len(vectors), TABLES, 1 + PROBES), np.uint64)
    planes = projections(vectors.shape[1])
    factors = mix(np.arange(1, 9, dtype=np.uint64) * M1) | np.uint64(1)
    with np.errstate(over="ignore"):
        salt = mix(labels.astype(np.int64).view(np.uint64) * M2 + M1)
        for t in range(TABLES):
            at = vectors @ planes[t]
            own = decode(at)
            near = np.argsort(-((at - own) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :PROBES]
            points = np.concatenate([own[:, None], own[:, None] + NEIGHBOURS[near]], axis=1)
            ints = np.rint(2 * points).astype(np.int64).view(np.uint64)
            out[:, t] = mix((ints * factors).sum(axis=2, dtype=np.uint64) + salt[:, None] + np.uint64(t) * M2)
    return out


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision and which rows are usable; vectors must be as wide as the widest kind in the batch."""
    rows = column.to_pylist()
    good = np.array([r is not None and len(r) > 0 and all(v is not None for v in r) for r in rows], bool)
    width = max((len(r) for r, g in zip(rows, good) if g), default=0)
    good &= np.array([r is not None and len(r) == width for r in rows], bool)
    out = np.zeros((len(rows), width))
    if good.any():
        out[good] = np.array([r for r, g in zip(rows, good) if g], float)
    with np.errstate(all="ignore"):
        top = np.abs(out).max(axis=1, initial=0)
        good &= np.isfinite(out).all(axis=1) & (top > 0)
        out = np.where(good[:, None], out / np.where(top > 0, top, 1)[:, None], 0)
        norms = np.sqrt((out**2).sum(axis=1))
    return out / np.where(norms > 0, norms, 1)[:, None], good


def _digests(batches):
    """Of each usable vector a digest of label and components."""
    for batch in batches:
        wide, column = {}, batch.column("embedding")
        usable = np.zeros(batch.num_rows, bool)
        lengths = [-1 if v is None else v for v in column.value_lengths().to_pylist()]
        for i, n in enumerate(lengths):
            wide.setdefault(n, []).append(i)
        for n, rows in wide.items():
            if n > 0:
                usable[rows] = _matrix(column.take(pa.array(rows)))[1]
        labels = batch.column("label").to_pylist()
        ids = batch.column("vec_id").to_pylist()
        digests = [
            hashlib.blake2b(repr(label).encode() + (np.array(v, float) + 0.0).tobytes(), digest_size=16).digest() if ok and label is not None and i is not None else None
            for i, label, ok, v in zip(ids, labels, usable.tolist(), column.to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])


def _groups_by_width(column: pa.Array):
    lengths = np.array(column.value_lengths().to_pylist())
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _codes(batches):
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for rows in _groups_by_width(batch.column("embedding")):
            unit, _ = _matrix(batch.column("embedding").take(pa.array(rows)))
            for at in range(0, len(rows), 2000):
                own = rows[at : at + 2000]
                codes = cells(unit[at : at + 2000], labels[own]).reshape(len(own), -1)
                home = np.tile(np.arange(TABLES * (1 + PROBES)) % (1 + PROBES) == 0, len(own))
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel().view(np.int64)), pa.array(np.repeat(ids[own], codes.shape[1])), pa.array(home)], ["bucket", "vec_id", "home"])


def _first_common(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The first bucket in which two vectors meet with one of them at home; u and v are their cells, row by row."""
    out, open_ = np.zeros(len(u), np.uint64), np.ones(len(u), bool)
    for t in range(TABLES):
        for own, other in ((u, v), (v, u)):
            hit = open_ & (other[:, t] == own[:, t, :1]).any(axis=1)
            out[hit] = own[hit, t, 0]
            open_ &= ~hit
    return out


def _verify(least: float):
    """In a bucket: links of members by cosine, each counted where the two first meet, and a forest of the links."""

    def run(batches):
        for table, cuts in sorted_groups(batches, "key"):
            ids, labels, sizes = (table.column(c).to_numpy() for c in ("vec_id", "label", "size"))
            homes, buckets = table.column("home").to_numpy(zero_copy_only=False), table.column("bucket").to_numpy().view(np.uint64)
            i, j, own = (table.column(c).to_numpy() for c in ("i", "j", "own"))
            vectors = table.column("embedding").combine_chunks()
            rows: list[tuple[int, int, int]] = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                for members in _groups_by_width(vectors.slice(x, y - x)):
                    members = members + x
                    members = members[np.argsort(ids[members], kind="stable")]  # so that two vectors are in one order everywhere
                    unit, _ = _matrix(vectors.take(pa.array(members)))
                    like = np.triu(unit @ unit.T >= least, 1)
                    like &= labels[members][:, None] == labels[members]
                    a, b = np.nonzero(like)
                    if not len(a):
                        continue
                    met = homes[members[a]] | homes[members[b]]
                    a, b = a[met], b[met]
                    ma, mb = members[a], members[b]
                    here = (np.minimum(own[ma], own[mb]) == i[ma]) & (np.maximum(own[ma], own[mb]) == j[ma])
                    a, b, ma, mb = a[here], b[here], ma[here], mb[here]
                    if not len(a):
                        continue
                    involved, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                    codes = cells(unit[involved], labels[members[involved]])
                    root = np.arange(len(members))
                    for p, q in zip(a.tolist(), b.tolist()):
                        if root[p] != root[q]:
                            root[root == root[q]] = root[p]
                    links = np.zeros(len(members), np.int64)
                    for at in range(0, len(a), 50_000):
                        part = slice(at, at + 50_000)
                        first = _first_common(codes[back[: len(a)][part]], codes[back[len(a) :][part]]) == buckets[ma[part]]
                        np.add.at(links, a[part][first], sizes[mb[part]][first])
                        np.add.at(links, b[part][first], sizes[ma[part]][first])
                    rows += [(int(ids[members[m]]), int(links[m]), int(ids[members[root[m]]])) for m in involved.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["vec_id", "links", "other"])

    return run


def link_embeddings(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): vectors of the same label whose cosine is ``least`` or more link.

    Equal vectors of a label are one class first. A class's unit vector is projected to 8 dimensions in each of TABLES
    tables, decoded to the nearest point of the E8 lattice, and enters that cell's bucket and those of the PROBES
    neighbouring cells that are nearest. In a bucket the cosines are computed in double precision, large buckets by
    pairs of blocks of members. A link counts in the bucket in which its vectors first meet, so no pair ever leaves a
    task; what leaves are each member's number of links and a forest of them.

    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable. Vectors that are
    null, empty, zero or hold a null or non-finite component, and those without label or id, link with nothing. Rows
    that repeat a vec_id are one vector and give one row where their class is the same, or where none can link; a vec_id
    with unlike vectors has a row for each class. Every row without an id gives a row. Vectors of different width never
    link, and may be of any width. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    own = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_digests, "vec_id long, label long, embedding array<double>, digest binary"), "vectors")
    classes = own.filter("digest IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("vec_id", "label", "embedding"), "vec_id").alias("x"), F.count_distinct("vec_id").alias("size"))
    classes = stored(classes.select("digest", "size", "x.*"), "classes")
    codes = classes.select("vec_id", "label", "embedding").mapInArrow(_codes, "bucket long, vec_id long, home boolean").groupBy("bucket", "vec_id").agg(F.max("home").alias("home"))
    codes = stored(codes, "codes")
    sizes = codes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).filter("n > 1 AND any").select("bucket", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    met = codes.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    met = met.select("bucket", "vec_id", "home", "own", F.explode(pairs).alias("p")).select("bucket", "vec_id", "home", "own", "p.*", F.xxhash64("bucket", "p.i", "p.j").alias("key"))
    met = met.join(classes.drop("digest"), "vec_id").repartition("key").sortWithinPartitions("key")
    found = stored(met.mapInArrow(_verify(least), "vec_id long, links long, other long"), "links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "first")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    of = classes.select("digest", "size", F.col("vec_id").alias("first")).join(links, "first", "left").join(joined, F.col("first") == joined["id"], "left").drop("id")
    usable = own.filter("digest IS NOT NULL").select("vec_id", "digest").distinct().join(of, "digest")
    alone = own.filter("digest IS NULL AND vec_id IS NOT NULL").select("vec_id").distinct().unionByName(own.filter("vec_id IS NULL").select("vec_id"))
    out = usable.unionByName(alone, allowMissingColumns=True)
    n_links = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
