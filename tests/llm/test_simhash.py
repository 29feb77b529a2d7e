import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chapterloom.llm import simhash
from chapterloom.llm.components import components

SCHEMA = "doc_id long, text string, fp string, root int, node int"


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAÉ .\t\n\x1c\x85 ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == (plain(text),)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts) * 7 % 1009] = " ".join(copy)
    texts |= {5000: "", 5001: None, 5002: " \n", 5003: "One Two", 5004: "one  two"}
    rows = [(i, t, "z", 1, 2) for i, t in texts.items()]
    rows += [(5003, "One Two", "z", 1, 2), (5010, "long " * 50000, None, 0, 0), (None, "one two", "z", 1, 2)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    prints = {i: plain(t or "") for i, t, *_ in rows if i is not None}
    expected = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for r in found:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == prints[r.doc_id] and r.component_id == expected[r.doc_id]
    assert [r.component_id for r in found if r.doc_id is None] == [expected[5003]]


def around(rng, base, bits, counts):
    """Fingerprints round one centre, at every distance, with differences at the ends of segments and halves."""
    return {base ^ sum(1 << b for b in rng.sample(bits, k)) for k in counts for _ in range(60)}


def linked(spark, prints, distance=4):
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    nodes = spark.createDataFrame([(p, 1, p) for p in signed], "node long, n int, fp0 long")
    found = {r.node: r.component for r in simhash._linked(nodes, simhash._Links(None, 4, 1, distance, None)).collect()}
    wanted = groups(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    assert {n: found.get(n, n) for n in signed} == wanted
    return nodes


@pytest.mark.parametrize("place,dense,thin", [(20_000, 2_000, 2), (20_000, 3, 100), (17, 2_000, 100), (9, 3, 1)])
def test_dense_and_border_links(spark, monkeypatch, place, dense, thin):
    """Also with places dealt into blocks, and with dense nodes linked in two steps."""
    monkeypatch.setattr(simhash, "PLACE", place)
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "THIN", thin)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    ends = [0, 9, 10, 20, 21, 30, 31, 41, 42, 51, 52, 62, 63, 5, 25]
    prints = {base} | around(rng, base, ends, (1, 2, 3, 4, 5, 6, 7, 8)) | {rng.getrandbits(64) for _ in range(50)}
    prints |= around(rng, rng.getrandbits(64), list(range(64)), (1, 3, 5))
    nodes = linked(spark, prints)
    if (place, dense, thin) == (20_000, 2_000, 2):
        signed = sorted(r.node for r in nodes.collect())
        found = simhash.search(nodes.withColumn("root", nodes.node), words=1, distance=4, all_pairs=True)
        found = {tuple(sorted((r.a, r.b))) for r in found.collect() if r.a is not None}
        assert found == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_many_pairs_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFIED", 10)
    monkeypatch.setattr(simhash, "GATHERED", 100)
    rng = random.Random(6)
    linked(spark, around(rng, 77, list(range(12)), (1, 2, 3)))


def jaccard(a, b, k=5):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_texts(spark):
    """Links by shared shingles: never below the threshold, and at least nine of ten above it."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2, len(copy) // 60])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " ", "one two", "One  two", "one two three"]
    nodes = sorted({t or "" for t in texts})
    rows = [(i, t) for i, t in enumerate(texts)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=5, distance=60, similarity=0.8).collect()
    assert len(found) == len(rows)
    near = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if jaccard(a, b) >= 0.8}
    wanted = groups(nodes, lambda a, b: (a, b) in near)
    component = {r.doc_id: r.component_id for r in found}
    of = {t or "": component[i] for i, t in rows}
    assert all(component[i] == of[t or ""] for i, t in rows)
    for a in nodes:
        for b in nodes:
            if of[a] == of[b]:
                assert wanted[a] == wanted[b]
    assert sum(of[a] == of[b] for a, b in near) >= 0.9 * len(near) > 50
    assert of["one two"] == of["One  two"] != of["one two three"] and of[""] == of[" "]


def test_dense_texts_below_the_similarity(spark):
    """A large group of texts that all resemble each other, but few of them enough: the second search gives about the pairs
    that are links, not the square of the group, and every link that it gave without parities."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base, texts = [rng.choice(words) for _ in range(200)], []
    for i in range(120):
        copy = list(base if i % 10 else base[:195])
        for _ in range(1 if i % 10 == 0 else 4):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash.fingerprints(docs, 5, 5).selectExpr("kept.doc_id node", "kept.doc_id root", "*")
    found = simhash.search(nodes, words=5, distance=60, similarity=0.8, all_pairs=True).where("a is not null").select("a", "b").distinct()
    got = {(r.a, r.b) for r in found.collect()}
    prints = [simhash.fingerprint(t, 5, 5) for t in texts]
    close = {(i, j) for j in range(120) for i in range(j) if sum((x ^ y).bit_count() for x, y in zip(prints[i], prints[j])) <= 60}
    shared = lambda x, y: any((x >> s ^ y >> s) & (1 << b) - 1 in {0, *(1 << k for k in range(b))} for s, b in simhash.SEGMENTS)
    close = {(i, j) for i, j in close if any(map(shared, prints[i], prints[j]))}
    links = {(i, j) for i, j in close if jaccard(texts[i], texts[j]) >= 0.8}
    assert links <= got <= close and len(links) > 50
    assert len(got) < len(links) + 0.1 * (len(close) - len(links)) and len(close) > 1000


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=300), st.sets(st.integers(0, 3000), max_size=60), st.sets(st.integers(0, 3000), max_size=60))
def test_parities_never_exclude_similar_sets(held, more, less):
    x, y = (np.array(sorted(xxhash.xxh64_intdigest(str(i)) for i in s), np.uint64) for s in (held, (held - less) | more))
    differ = np.bitwise_count(np.frombuffer(simhash.parities(x), np.uint8) ^ np.frombuffer(simhash.parities(y), np.uint8)).sum()
    common = len(np.intersect1d(x, y))
    assert differ <= len(x) + len(y) - 2 * common
    for similarity in (0.5, 0.8, 1.0):
        if common * (1 + similarity) >= similarity * (len(x) + len(y)) - 1e-9:
            assert differ <= simhash.allowed(len(x) + len(y), similarity)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(300, 200), (250, 300), (7, 7), (1, 0), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p if x is not None})
    linked = {p for p in pairs if None not in p}
    assert found == groups(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
