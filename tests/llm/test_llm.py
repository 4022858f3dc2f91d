import collections
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import bpe, fingerprints, lattice_dedup, lm_scoring, minhash, packing, pii, queries, toxicity
from docspark.llm.common import components
from docspark.llm.line_dedup import drop_common_lines
from docspark.llm.lm_scoring import score_documents
from docspark.llm.substring_dedup import drop_repeated_passages

DOCS = "doc_id long, text string, key string, at int, bucket string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n)]


def corpus():
    """Nulls, empty and long texts, copies, near copies, a shared passage, common lines, ties and repeated rows."""
    r = random.Random(7)
    passage, base = " ".join(words(40, 1)), words(80, 2)
    texts = [None, "", " \n\t ", "a", "one two three", "Same LINE\nother", " \n".join(words(3000, 3)), "x" * 5000, "\x0bv\x0c w\x1cz q é Σ", "İstanbul ΑΣ don't 12\n\nend"]
    texts += [f"{' '.join(words(30, 10 + i))}\n  Common Line \n{passage if i % 3 == 0 else ''}\ntail {i}" for i in range(14)]
    for i in range(12):
        own = list(base)
        for _ in range(i):
            own[r.randrange(len(own))] = f"new{i}"
        texts.append(" ".join(own))
    texts += [texts[12]] * 3 + [texts[30].upper()]
    ids = list(range(0, 3 * len(texts), 3))
    r.shuffle(ids)
    return dict(zip(ids, texts))


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, "b") for i, t in texts.items()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and a null id."""
    rows = [(5, "a b c d e f", "k", 1, "b")] * 2 + [(None, "a b c d e f", "k", 1, "b"), (6, None, "k", 1, "b"), (6, "", "k", 1, "b")]
    return spark.createDataFrame(rows, DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


class Classes:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        x, y = sorted((self.find(a), self.find(b)))
        self.up[y] = x


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    c = Classes({x for p in pairs for x in p})
    for a, b in pairs:
        c.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: c.find(x) for x in c.up if c.find(x) != x}


def test_embeddings(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    vectors = [(i, (base[i % 40] + r.normal(size=16) * [0, 0.05, 0.12][i // 40]).tolist(), i % 2) for i in range(120)]
    vectors += [(200 + i, [0.5] * 16, 1) for i in range(4)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] + [1.0] * 15, 1), (303, [0.5] * 16, None), (304, [None] + [1.0] * 15, 1), (305, [1.0] * 16, 1), (306, [1.0] * 3, 1), (307, [], 1)]
    frame = spark.createDataFrame([(a, b, c, "d") for a, b, c in vectors], "vec_id long, embedding array<float>, label int, digest string")
    got = rows(lattice_dedup.link_embeddings(frame, 0.98), "vec_id")
    good = {}
    for i, v, label in vectors:
        x = np.array(v, float) if v and None not in v else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            x = x.astype(np.float32).astype(float)
            good[i] = (label, x / np.linalg.norm(x))
    c, links = Classes([v[0] for v in vectors]), collections.Counter()
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(good.items(), 2):
        if a == b and len(x) == len(y) and x @ y >= 0.98:
            c.join(i, j)
            links[i] += 1
            links[j] += 1
    assert {i: (g.n_links, g.component_id, g.kept) for i, g in got.items()} == {i: (links[i], c.find(i), c.find(i) == i) for i in c.up}
    assert sum(links.values()) > 40
    twice = frame.unionByName(frame.filter("vec_id < 40 OR vec_id = 300")).unionByName(spark.createDataFrame([(None, [0.5] * 16, 1, "d")] * 2, frame.schema))
    again = lattice_dedup.link_embeddings(twice, 0.98).collect()
    assert len(again) == len(vectors) + 2 and {g.vec_id: (g.n_links, g.component_id, g.kept) for g in again if g.vec_id is not None} == {i: (g.n_links, g.component_id, g.kept) for i, g in got.items()}
    assert [(g.n_links, g.component_id, g.kept) for g in again if g.vec_id is None] == [(0, None, False)] * 2
    assert lattice_dedup.link_embeddings(frame.limit(0)).count() == 0


@pytest.mark.parametrize("width", [32, 384])
def test_lattice_recall(spark, width):
    """Planted pairs at cosines from 0.98 up, among vectors of one label, against brute force."""
    r = np.random.default_rng(width)
    base = r.normal(size=(400, width))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=(400, width))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = np.linspace(0.9801, 0.999, 400)[:, None]
    both = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<float>, label int")
    got = rows(lattice_dedup.link_embeddings(frame, 0.98), "vec_id")
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    recall = sum(g.n_links for g in got.values()) / want.sum()
    print(f"recall at width {width}: {recall:.4f}")
    assert recall > 0.99 and all(g.n_links <= want[i] for i, g in got.items())


def test_e8_decoding():
    x = np.random.default_rng(0).normal(size=(200, 8)) * 3
    near = lattice_dedup.decode(x)
    assert ((near * 2) % 1 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    assert (((x - near) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - near[:, None] - lattice_dedup.NEIGHBOURS) ** 2).sum(axis=2) + 1e-9).all()


def test_pii(spark, none):
    permute = pii.Permutation(b"k")
    for n in (1, 2, 10, 97, 1000):
        assert sorted(permute(x, n, b"t") for x in range(n)) == list(range(n))
    text = "Mail maria.12@mail3.example.com, card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; born 1990-02-28, 31/12/1999, no 2021-02-30; ip 10.20.30.40 not 10.20.30.400; ssn 123-45-6789; +1 (736) 555-2678; DE89 3704 0044 0532 0130 00"
    out, kinds = pii.pseudonymise(text, permute)
    assert kinds == ["email", "card", "card", "date", "date", "ip", "ssn", "phone", "iban"]
    for old in ("maria.12", "4111 1111 1111 1111", "4111111111111111", "1990-02-28", "31/12/1999", "10.20.30.40 ", "123-45-6789", "555-2678", "DE89"):
        assert (old in out) == (old == "DE89" and "DE89" in out)
    for same in ("4111111111111112", "2021-02-30", "10.20.30.400"):
        assert same in out
    spans = pii.spans(out, permute)
    assert [k for _, _, k, _ in spans] == kinds  # pseudonyms are valid in their format
    cards = [out[s:e].replace(" ", "") for s, e, k, _ in spans if k == "card"]
    assert cards[0] == cards[1] and pii.luhn(cards[0])
    frame = spark.createDataFrame([(1, text, [9]), (2, None, None), (3, "", None), (4, "no one", None)], "doc_id long, text string, pii array<int>")
    got = rows(pii.replace_pii(frame))
    assert len(got[1].pii) == 9 and (got[2].text, got[2].pii, got[3].text, got[4].text) == (None, [], "", "no one")
    assert pii.replace_pii(none).count() == 0


def test_pii_formats_and_links():
    permute = pii.Permutation(b"k")
    swap = lambda t: pii.pseudonymise(t, permute)[0]
    for day in ("1/2/1999", "01/02/1999", "1999-1-02", "31.12.1999", "7-8-2007"):
        assert re.sub(r"\d", "0", swap(day)) == re.sub(r"\d", "0", day) and swap(day) != day
    days = [f"{d}/{m}/1999" for m in range(1, 10) for d in range(1, 10)]
    assert len({swap(d) for d in days}) == len(days)
    a, b, c = swap("ann@Mail.Example.org"), swap("bob@mail.example.org"), swap("ann@mail.example.net")
    assert a.partition("@")[2].lower() == b.partition("@")[2] and a.endswith(".org") and c.endswith(".net")
    assert "xample" not in a + b + c and a.partition("@")[2][0].isupper()
    assert swap("see 10.1.2.3 @ no and @only.com") .endswith(" @ no and @only.com")
    assert pii.Permutation(b"other")(5, 1000, b"t") != permute(5, 1000, b"t") or pii.Permutation(b"other")(6, 1000, b"t") != permute(6, 1000, b"t")


def test_pii_takes_time_in_proportion():
    permute = pii.Permutation(b"k")

    def seconds(text):
        began = time.process_time()
        pii.spans(text, permute)
        return time.process_time() - began

    for make in (lambda n: "a" * n + "@", lambda n: "x@y.org " * (n // 8), lambda n: "1 " * (n // 2) + "@", lambda n: "a.b-" * (n // 4) + "@" + "c." * (n // 2)):
        small, large = (min(seconds(make(n)) for _ in range(2)) for n in (5_000, 40_000))
        assert large < 30 * max(small, 0.003)


def test_pii_beside_other_groups():
    permute = pii.Permutation(b"key")
    for text, value, kind in (
        ("card 4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"),
        ("item 3 4111111111111111", "4111111111111111", "card"),
        ("4111111111111111 123", "4111111111111111", "card"),
        ("paid 12-05-2027 4111 1111 1111 1111 on", "4111 1111 1111 1111", "card"),
        ("BE68 5390 0754 7034 EUR", "BE68 5390 0754 7034", "iban"),
        ("ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332", "iban"),
        ("AB12 CDEF GHIJ BE68 5390 0754 7034", "BE68 5390 0754 7034", "iban"),
    ):
        found = [(text[s:e], k) for s, e, k, _ in pii.spans(text, permute)]
        assert (value, kind) in found, text
    two = "4111 1111 1111 1111 5500 0000 0000 0004 7"
    assert [two[s:e] for s, e, *_ in pii.spans(two, permute)] == ["4111 1111 1111 1111", "5500 0000 0000 0004"]
    assert not pii.spans("4111 1111 1111 1112 12 and BE68 5390 0754 7035 EUR", permute)


def test_line_dedup(docs, texts, odd, none):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    seen = collections.defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    got = rows(drop_common_lines(docs, 10))
    dropped = 0
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < 10]
        dropped += len(lines) - len(kept)
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert dropped >= 14
    assert drop_common_lines(odd, 2).count() == 5 and drop_common_lines(none).count() == 0
    assert {r.kept for r in drop_common_lines(odd, 2).collect()} == {""}


def test_substring_dedup(docs, texts, odd, none):
    first = {}
    for i in sorted(texts):
        own = split(texts[i])
        for k in range(len(own) - 12):
            first.setdefault(tuple(own[k : k + 13]), i)
    got, removed = rows(drop_repeated_passages(docs, 13)), 0
    for i, t in texts.items():
        own, gone = split(t), set()
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        removed += len(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(own), len(gone), " ".join(x for k, x in enumerate(own) if k not in gone))
    assert removed > 200
    assert sorted(r.n_removed for r in drop_repeated_passages(odd, 3).collect()) == [0, 0, 0, 0, 6]
    assert drop_repeated_passages(none).count() == 0


def test_toxicity(spark, none):
    r = random.Random(3)
    bad = ["vilestem" + x for x in ("a", "bo", "cur", "dan", "eks", "fil")]
    made, labels = [], []
    for i in range(900):
        own, toxic = words(60, 100 + i), i % 6 == 0
        if toxic:
            own[r.randrange(60)] = r.choice(bad)
        made.append((i, " ".join(own), 0.5))
        if i < 600:
            labels.append((i, int(i % 4 != 0), int(toxic)))
    made += [(1000, None, 0.5), (1001, "", 0.5)]
    docs, labels = spark.createDataFrame(made, "doc_id long, text string, p_toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows(toxicity.score_toxicity(docs, labels, toxicity.label_categories()))
    held = [(got[i].p_toxic >= 0.5) == (i % 6 == 0) for i in range(600, 900)]
    assert sum(held) / len(held) > 0.97 and got[1000].p_toxic < 0.5 and len(got) == 902
    assert max(x.p_toxic for x in toxicity.score_toxicity(docs, labels.limit(0), toxicity.label_categories()).collect()) <= 0.5
    assert toxicity.score_toxicity(none, labels, toxicity.label_categories()).count() == 0
    odd = spark.createDataFrame([(3, "vilestema")] * 2 + [(None, "vilestema"), (None, None)], "doc_id long, text string")
    assert toxicity.score_toxicity(docs.drop("p_toxic").unionByName(odd), labels, toxicity.label_categories()).count() == 906


def test_bpe(docs, texts, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.word_bpe())
    more = {**texts, -1: "<|endoftext|>hi <|startoftext|>", -2: "a" * 500 + "the" * 90, -3: "日本語\U0001fae8 ͸ x\x1c!"}
    model = bpe.Model(bpe.read_spec(queries.word_bpe()))
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: model.merge(w) for w in (b"the", b"them", b"then", b"hen", b"a")}))
    assert lexicon.find([b"them", b"th", b"thenx", b"", b"a"]) == [struct.pack("<I", *model.merge(b"them")), None, None, None, struct.pack("<I", *model.merge(b"a"))]
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"a", b"", b"them"]) == [None] * 3
    encoder = bpe.Encoder(model, lexicon, most=50)
    for t in more.values():
        ids = own.encode(t or "", add_special_tokens=False).ids
        packed = encoder.encode(t or "")
        assert packed == struct.pack(f"<{len(ids)}I", *ids)
        assert bpe.Decoder(model.tokens).decode(np.array(ids, np.uint32), np.array([0, len(ids)])).to_pylist() == [own.decode(ids, skip_special_tokens=False)]
    ids, begin = encoder.encode_many([t or "" for t in more.values()])
    assert [ids[x:y].tobytes() for x, y in itertools.pairwise(begin)] == [encoder.encode(t or "") for t in more.values()]
    got = rows(bpe.encode_documents(docs, queries.word_bpe()))
    assert {i: bytes(g.ids) for i, g in got.items()} == {i: encoder.encode(t or "") for i, t in texts.items()}
    assert bpe.encode_documents(none, queries.word_bpe()).count() == 0


def test_lm_scoring(docs, texts, odd, none):
    tokens = {i: [w.encode() for w in split(lower(t))] + [0] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    got = rows(score_documents(docs))
    for i, own in tokens.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(own), sum(c[w] > 0 for w in own), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) and g.score <= 0
    assert sum(g.score for g in got.values()) > sum(g.base_score for g in got.values())
    assert score_documents(odd).count() == 5 and score_documents(none).count() == 0
    assert {i: g.score for i, g in rows(score_documents(docs, room=200)).items()} == {i: pytest.approx(g.score) for i, g in got.items()}
    bigrams = collections.Counter(b for i, own in tokens.items() if not held[i] for b in zip(["<s>", *own], own))
    levels = {b: int(math.log2(x)) for b, x in bigrams.items()}
    follows, mass = collections.Counter(), collections.Counter()
    for (u, w), x in bigrams.items():
        follows[u] += x
        mass[u] += 2 ** levels[u, w] - lm_scoring.DISCOUNT

    def p(u, w):
        base = (c[w] + 0.1) / (n + 0.1 * (v + 1))
        kept = 2 ** levels[u, w] - lm_scoring.DISCOUNT if (u, w) in levels else 0
        return (kept + (follows[u] - mass[u] + lm_scoring.PRIOR) * base) / (follows[u] + lm_scoring.PRIOR)

    for i, own in tokens.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *own], own)))


def test_lm_probabilities_sum_to_one():
    """Over all words that are known and one for the others, after rare and common contexts, false hits included."""
    r = np.random.default_rng(2)
    v, contexts = 50_000, [(1, 1), (2, 2), (10, 7), (100, 60), (100_000, 20_000)]
    counts = 1 + r.zipf(1.5, v).clip(max=10**6).astype(float)
    base = np.append(counts + 0.1, 0.1) / (counts.sum() + 0.1 * (v + 1))
    entered, levels, made = [], [], []
    for k, (total, distinct) in enumerate(contexts * 20):
        words = r.choice(v, min(distinct, total), replace=False)
        seen = np.ones(len(words), int)
        np.add.at(seen, r.integers(0, len(words), total - len(words)), 1)
        key = lm_scoring.mix(np.uint64(k << 32) + words.astype(np.uint64))
        entered.append(key)
        levels.append(np.floor(np.log2(seen)).astype(int))
        made.append((k, total, float((2.0 ** levels[-1] - lm_scoring.DISCOUNT).sum())))
    order = np.argsort(key := np.concatenate(entered))
    segment = lm_scoring.Segment(key[order], np.concatenate(levels)[order], lm_scoring.probes_for(v))
    for k, total, mass in made:
        found = np.append(segment.levels(lm_scoring.mix(np.uint64(k << 32) + np.arange(v, dtype=np.uint64))), 0)
        p = lm_scoring.probability(found, np.full(v + 1, float(total)), np.full(v + 1, mass), base)
        assert (p > 0).all() and p.sum() == pytest.approx(1, abs=0.01)


def test_lm_filter_forgets_nothing():
    r = np.random.default_rng(3)
    key, level = np.unique(r.integers(0, 2**64, 20_000, np.uint64)), r.geometric(0.5, 20_000) - 1
    got = lm_scoring.Segment(key, level, 4).levels(key).astype(int) - 1
    assert (got >= level).all() and (got > level).mean() < 1e-3
    absent = r.integers(0, 2**64, 2_000_000, np.uint64)
    hits = [(lm_scoring.Segment(key, level, n).levels(absent) > 0).mean() for n in (1, 2, 3)]
    assert hits[0] < 2**-9 and hits[1] < 2**-16 and hits[2] < 2**-19
    assert not lm_scoring.Segment(key[:0], level[:0], 2).levels(key).any()


@pytest.mark.parametrize("size", [256, 4096])
def test_packing(docs, texts, odd, none, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.word_bpe())
    library.no_truncation()
    library.no_padding()
    got = collections.defaultdict(list)
    for r in packing.pack_documents(docs, queries.word_bpe(), size, 2).collect():
        got[r.doc_id].append(r)
    sequences, padding, total, needless = collections.defaultdict(list), 0, 0, 0
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        raw, at = struct.pack(f"<{len(ids)}I", *ids), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
            sequences[r.sequence_id].append((r.offset, r.length))
        assert at == len(ids)
        needless += len(got[i]) > -(-len(ids) // size)
    assert sorted(sequences) == list(range(len(sequences))) and needless <= 3
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    assert len(sequences) <= total / size * 1.25 + 1
    assert packing.pack_documents(odd, queries.word_bpe()).count() >= 5 and packing.pack_documents(none, queries.word_bpe()).count() == 0


def test_packing_plans():
    solved = packing.generate_patterns([5, 4, 3], [30, 20, 10], 10)
    assert sum(x for x, _ in solved) == pytest.approx(27.5) and all(p @ [5, 4, 3] <= 10 for _, p in solved)
    r = random.Random(5)
    mixed = collections.Counter(x for n in (int(r.lognormvariate(6, 1)) + 1 for _ in range(20_000)) for _, x in packing.cut(n, 4096, r.random() < 0.02))
    for counts, most in ((mixed, 1e-4), ({5: 100_000}, 0.01), ({64: 7, 63: 100_000, 1: 3}, 0.001), ({4095: 50, 1: 10}, 0.001), ({100: 100_000, 101: 50_000}, 0.03), ({4096: 3}, 0), ({}, 0)):
        rows, n = packing.plan(counts, 4096)
        held, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for x, lo, hi, sequence, offset in rows:
            ranks[x] += range(lo, hi)
            for s in range(sequence, sequence + hi - lo):
                held[s].append((offset, x))
        assert {x: sorted(v) for x, v in ranks.items()} == {x: list(range(k)) for x, k in counts.items()}
        assert sorted(held) == list(range(n))
        for own in held.values():
            at = 0
            for offset, x in sorted(own):
                assert offset == at
                at += x
            assert at <= 4096
        assert n * 4096 * (1 - most) <= sum(x * k for x, k in counts.items()) + 4096


def test_minhash(docs, texts, odd, none):
    def sets(k):
        out = {}
        for i, t in texts.items():
            w = split(lower(t))
            out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        return out

    own, c = sets(4), Classes(texts)
    for a, b in itertools.combinations(texts, 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
            c.join(a, b)
    got = rows(minhash.near_duplicates(docs, 4, 80))
    assert {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()} == {i: (len(own[i]), c.find(i), c.find(i) == i) for i in texts}
    assert sum(not g.kept for g in got.values()) >= 5
    assert minhash.near_duplicates(odd).count() == 5 and minhash.near_duplicates(none).count() == 0
    bounds = minhash.least_matches(80, 1e-4)
    assert bounds == sorted(bounds) and 0.55 < bounds[-1] / minhash.HASHES < 0.75


def test_fingerprints(docs, texts, odd, none):
    got, order = rows(fingerprints.fingerprint_versions(docs)), sorted(texts)

    def own(t):
        return set(fingerprints.digests(pa.array([t]))[0].tolist())

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, after in zip(order, order[1:] + order[:1]):
        t, u = texts[i] or "", texts[after] or ""
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        g = got[i]
        assert (g.n_chars, g.edited) == (len(t), edited)
        assert g.near_edited == pytest.approx(like(own(t), own(edited))) and g.near_next == pytest.approx(like(own(t), own(u)))
    by = collections.defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert fingerprints.fingerprint_versions(odd).count() == 5 and fingerprints.fingerprint_versions(none).count() == 0


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    extra = {10_000 + i: " ".join(words(50, 500 + i)) + (" vilestemo" if i % 5 == 0 else "") for i in range(300)}
    every = {**texts, **extra}
    made = [(i, t, "en", "s", len(t or "")) for i, t in every.items()]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10_000 + i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        kept[name] = rows(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(every) - set(kept["toxicity"]) == {10_000 + i for i in range(300) if i % 5 == 0}
    assert set(kept["line_dedup"]) == set(kept["toxicity"]) and not any("Common Line" in (r.text or "") for r in kept["line_dedup"].values())
    copies = [i for i, t in texts.items() if t == corpus()[min(j for j, u in texts.items() if u == texts[i])] and list(texts.values()).count(t) == 4]
    assert len([i for i in copies if i in kept["minhash_dedup"]]) == 1
    assert set(kept["pii"]) == set(kept["minhash_dedup"]) == set(kept["packing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Repeated rows, repeated and null ids, null texts, and columns named like the operators' own."""
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one, two, three = (" ".join(words(40, s)) for s in (1, 2, 3))
    made = [(5, one), (5, one), (5, two), (3, two), (None, one), (None, three), (None, three), (7, None), (7, ""), (8, None)]
    schema = "doc_id long, text string, n_chars long, row string, pii string, p_toxic double, kept int, key string"
    docs = spark.createDataFrame([(i, t, 0, f"r{k}", "p", 0.9, 1, "k") for k, (i, t) in enumerate(made)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.stored(stage(spark, corpus_pipeline.stored(docs, "odd"), str(tmp_path)), name)
        assert got.columns == docs.columns
        kept = sorted(r["row"] for r in got.collect())
        if name == "minhash_dedup":
            assert len(kept) == 6 and "r3" in kept and "r2" not in kept and {"r7", "r8", "r9"} <= set(kept)
            assert len({"r0", "r1"} & set(kept)) == 1 and "r4" not in kept and len({"r5", "r6"} & set(kept)) == 1
        else:
            assert kept == sorted(f"r{k}" for k in range(len(made))) and {(r.pii, r.p_toxic, r.kept) for r in got.collect()} == {("p", 0.9, 1)}
        assert stage(spark, corpus_pipeline.stored(docs.limit(0), "none"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").count() >= len(made)


def test_digest_columns(spark):
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 11))
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).selectExpr("sha2(cast('' AS binary), 256) AS h").first().h


def test_components_free_finished_rounds(spark):
    import time

    from docspark.llm.common import components

    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = held.size()
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    found = components(edges)
    for _ in range(50):
        if held.size() <= before + 4:
            break
        time.sleep(0.2)
    assert held.size() <= before + 4  # those of the last count; shuffles of rounds whose edges are stored are gone
    assert {(r.id, r.component) for r in found.collect()} == {(i, 0) for i in range(1, 61)}
