"""MinHash near-dedup: banded candidates, sequential Bayesian pruning on signatures, exact verification of survivors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import LOWER, M2, components, mix, shingle_hashes, sorted_groups, span_hashes, stored, utf8, word_spans

#: Hashes of a signature, rows of a band, hashes compared in one step, members of a bucket that one task compares.
HASHES, ROWS, STEP, GROUP = 96, 4, 32, 2048
_SIGNED = "doc_id long, n_shingles long, key1 long, key2 long, signature binary"
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * M2) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z in lower case."""
    data, at = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, at)
    hashes, begin = shingle_hashes(span_hashes(data, starts, ends), first, k)
    return [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(at) - 1)]


def signature(own: np.ndarray) -> np.ndarray:
    """HASHES minima of a set under as many permutations, 16 bits of each."""
    least = np.full(HASHES, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 4096):
            np.minimum(least, (own[at : at + 4096, None] * _FACTORS).min(axis=0), out=least)
    return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2")


def _sign(k: int):
    def run(batches):
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, own in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), k)):
                    with np.errstate(over="ignore"):
                        key1, key2 = own.sum(dtype=np.uint64), mix(own ^ M2).sum(dtype=np.uint64)
                    rows.append((doc, len(own), int(key1.view(np.int64)), int(key2.view(np.int64)), signature(own).tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], [f.split()[0] for f in _SIGNED.split(", ")])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("text"), k)
                begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(begin), pa.array(flat))], ["doc_id", "shingles"])

    return run


def least_matches(percent: int, miss: float) -> list[int]:
    """After each step of STEP hashes, the fewest matches at which P(similarity >= percent / 100) is still miss or more.

    The posterior of the similarity after m matches of n under a uniform prior is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= percent / 100
    bounds = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[high].sum() / mass.sum() >= miss:
                break
        bounds.append(m)
    return bounds


def _plausible(hub: np.ndarray, others: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of others that survive every step against the hub's signature, and their matches."""
    rows, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for i, least in enumerate(bounds):
        cols = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (others[rows, cols] == hub[cols]).sum(axis=1)
        stay = matches >= least
        rows, matches = rows[stay], matches[stay]
    return rows, matches


def plausible_forest(ids: np.ndarray, signatures: np.ndarray, bounds: list[int]) -> list[tuple[int, int]]:
    """Pairs of a bucket's members that join all those between which a chain of plausible links runs."""
    root = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    for h in range(len(ids) - 1):
        other = np.flatnonzero(root[h + 1 :] != root[h]) + h + 1
        if not len(other):
            continue
        rows = other[_plausible(signatures[h], signatures[other], bounds)[0]]
        for part in np.unique(root[rows]):
            out.append((int(ids[h]), int(ids[rows[root[rows] == part][0]])))
            root[root == part] = root[h]
    return out


def verified_forest(ids: np.ndarray, side: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], bounds: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of a cluster, verified on the full sets, that join all members between which a chain of links runs.

    Members are taken in turn; those not yet joined to one are compared by signature, and survivors verified, the best
    first. With two sides only pairs across them are compared.
    """
    root = np.arange(len(ids))
    two = (side != side[0]).any()
    out: list[tuple[int, int]] = []
    for h in range(len(ids) - 1):
        other = np.flatnonzero((root[h + 1 :] != root[h]) & ((side[h + 1 :] != side[h]) | (not two))) + h + 1
        if not len(other):
            continue
        rows, matches = _plausible(signatures[h], signatures[other], bounds)
        for x in other[rows[np.argsort(-matches, kind="stable")]].tolist():
            a, b = sets[h], sets[x]
            if root[x] == root[h] or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= percent * (len(a) + len(b) - common):
                out.append((int(ids[h]), int(ids[x])))
                root[root == root[x]] = root[h]
    return out


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)


def _join_plausible(bounds: list[int]):
    def run(batches):
        for table, cuts in sorted_groups(batches, "key"):
            ids, signatures = table.column("doc_id").to_numpy(), _signatures(table)
            yield _pairs([p for x, y in zip(cuts[:-1], cuts[1:]) if y - x > 1 for p in plausible_forest(ids[x:y], signatures[x:y], bounds)])

    return run


def _join_verified(bounds: list[int], percent: int):
    def run(batches):
        for table, cuts in sorted_groups(batches, "key"):
            ids, side, signatures = table.column("doc_id").to_numpy(), table.column("own").to_numpy(), _signatures(table)
            own = table.column("shingles").combine_chunks()
            at, flat = own.offsets.to_numpy(), own.values.to_numpy().view(np.uint64)
            out: list[tuple[int, int]] = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x > 1:
                    sets = [flat[at[i] : at[i + 1]] for i in range(x, y)]
                    out += verified_forest(ids[x:y], side[x:y], signatures[x:y], sets, bounds, percent)
            yield _pairs(out)

    return run


def _in_blocks(members: DataFrame, group: str, most: int) -> DataFrame:
    """Members of each group of two or more, dealt to pairs of blocks of about ``most``: (key, doc_id, own)."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(group, F.ceil(F.col("n") / most).cast("int").alias("cuts"))
    met = members.select(group, "doc_id").join(sizes, group).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    return met.select(group, "doc_id", "own", F.explode(pairs).alias("p")).select("doc_id", "own", F.xxhash64(group, "p.i", "p.j").alias("key"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): groups of documents whose shingle sets link.

    A set holds the hashes of all runs of ``words`` words (all words at once, where there are fewer). Documents link
    where 100 * intersection >= percent * union. Equal sets are one class from the start. Classes meet in buckets of
    banded signatures, where signatures are compared in batches: a pair ends when the posterior probability of a link
    falls under ``miss``. A forest of the survivors joins classes into clusters; a cluster's full sets then meet, and
    survivors between members not yet joined are verified exactly. Buckets and clusters of more than GROUP members
    are dealt to tasks by pairs of blocks. Only forests leave a task, so rows stay in proportion to the members.

    Each row of docs gives a row. Rows with the same doc_id are one document, whose sets may differ; a null doc_id
    links with nothing and has a null component_id. A text that is null, empty or without words has an empty set and
    stands alone. A very long text is taken whole: its set is one row. Extra columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_sign(words), _SIGNED), "signed")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    alone = signed.filter("n_shingles = 0")  # equal keys, but linked with nothing: they stay out of the join
    classes = stored(full.groupBy("key1", "key2", "n_shingles").agg(F.min_by(F.struct("doc_id", "signature"), "doc_id").alias("x")).select("key1", "key2", "n_shingles", "x.*"), "classes")
    width = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda j: F.xxhash64(j, F.substring("signature", j * width + 1, F.lit(width))))
    signatures = classes.select("doc_id", "signature")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("key").sortWithinPartitions("key")

    bounds = least_matches(percent, miss)
    met = _in_blocks(classes.select("doc_id", F.explode(band).alias("bucket")), "bucket", GROUP).join(signatures, "doc_id")
    near = components(dealt(met).mapInArrow(_join_plausible(bounds), "a long, b long"), "plausible")
    clusters = stored(_in_blocks(near.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")).unionByName(near.select(F.col("component").alias("doc_id"), F.col("component").alias("cluster")).distinct()), "cluster", GROUP // 4), "clusters")
    wanted = clusters.select("doc_id").distinct()
    sets = stored(docs.hint("merge").join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles array<long>"), "sets")
    full_sets = clusters.join(signatures, "doc_id").join(sets, "doc_id")
    joined = components(dealt(full_sets).mapInArrow(_join_verified(bounds, percent), "a long, b long"), "verified")
    out = signed.filter("n_shingles > 0").alias("s").join(classes.select("key1", "key2", "n_shingles", F.col("doc_id").alias("first")), ["key1", "key2", "n_shingles"], "left")
    out = out.join(joined, out["first"] == joined["id"], "left").drop("id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first")).alias("component_id"))
    out = out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
