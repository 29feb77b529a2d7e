"""The stages on a small corpus against what each must do to its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from chapterloom.llm import common, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = "the river ran under an old bridge and then into the wide green valley where people were singing of better days".split()
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        toxic = i % 8 == 0
        for w in ("idiot", "m0ron", "cl*wn") if toxic else ():
            text.insert(rng.randrange(len(text)), w)
        if i % 9 == 0:
            text.insert(3, f"user{i}@mail.example.com")
        docs.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(500 + i, docs[i + 1][1], "en", "s0", 0) for i in range(40)]
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, "word " * 20_000, "en", "s2", 0)]
    docs = [(i, t, la, s, len(t or "")) for i, t, la, s, _ in docs]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    stages, frame = {}, common.table(spark, f"file://{path}", "documents")
    stages["documents"] = frame.collect()
    for name, stage in corpus_pipeline.STAGES:
        frame = common.materialise(stage(spark, frame, f"file://{path}"), "test-stage")
        stages[name] = frame.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == list(corpus_pipeline.COLUMNS)
    return f"file://{path}", stages


def test_toxic_documents_go_and_clean_ones_stay(corpus):
    _, stages = corpus
    left = {r.doc_id for r in stages["toxicity"]}
    for r in stages["documents"]:
        bad = any(w in (r.text or "") for w in ("idiot", "m0ron", "cl*wn"))
        assert (r.doc_id in left) == (not bad)


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def near_groups(texts):
    """The smallest number of each text's component over Jaccard similarities of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if similar(a, sets[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_one_document_of_each_group_stays(corpus):
    _, stages = corpus
    before = sorted(stages["toxicity"], key=lambda r: r.doc_id)
    root = near_groups([r.text for r in before])
    assert {r.doc_id for r in stages["near-duplicates"]} == {r.doc_id for i, r in enumerate(before) if root[i] == i}


ODD = SCHEMA + ", size int, taken string, epochs int, part int, whole string, row_key string, class int, component string, kept int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with repeated and null ids, repeated rows, null columns, and columns that stages use for themselves."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = some(60)
    near = base.replace(base.split()[30], "other", 1)
    rows = [(1, base, "s0"), (2, near, "s1"), (3, base, "s0"), (3, some(40), "s1"), (3, some(50), "s1"), (4, some(30), None), (4, some(30), None)]
    rows += [(None, some(25), "s0"), (None, some(25), "s0"), (None, base, "s0"), (5, None, "s1"), (6, "", "s1"), (7, " \t", "s2"), (8, "one two", "s2")]
    rows += [(9, "one  two", "s2"), (10, some(3000), "s0"), (1, base, "s0"), (1, base, "s0"), (11, some(30), "s9"), (11, some(30), "s9")]
    rows = [(i, t, None, s, None if t is None else len(t), 7, "x", 7, 7, "x", "x", 7, "x", 7) for i, t, s in rows]
    path = f"file://{tmp_path_factory.mktemp('odd')}/odd.parquet"
    spark.createDataFrame(rows, ODD).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_near_duplicates_go_by_row(spark, odd):
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()]
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    root = near_groups([t for _, t in rows])
    assert len(left) == len(set(root))
    by_group = {}
    for n, row in enumerate(rows):
        by_group.setdefault(root[n], []).append(row)
    for group in by_group.values():
        kept = [row for row in group if row in left]
        assert kept and kept[0][0] == group[0][0]
    assert {t for i, t in left if i == 3} == {t for i, t in rows if i == 3 and t != next(t for i, t in rows if i == 1)}


def test_mix_goes_by_row(spark, odd):
    mixed = corpus_pipeline.mix_sources(spark, odd, "")
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    rows, out = odd.collect(), mixed.collect()
    size = lambda t: len((t or "").split())
    have, words = Counter(), Counter()
    for r in rows:
        have[r.source] += size(r.text)
    for r in out:
        words[r.source] += size(r.text)
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target = 1.5 * sum(have.values()), {}
    open_ = dict(weight)
    while True:  # fill by weight, close what is full
        level = left / sum(open_.values()) if open_ else 0
        full = [s for s in open_ if level * open_[s] >= 2 * have[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * have[s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    for s in have:
        assert abs(words[s] - target[s]) <= 1
    # Each row is taken at most twice, whole or from its start.
    given, taken = Counter((r.doc_id, r.text, r.source) for r in rows), Counter()
    for r in out:
        fits = [k for k in given if k[0] == r.doc_id and k[2] == r.source and (k[1] or "").startswith(r.text or "") and (r.text is None) == (k[1] is None)]
        assert fits
        taken[next((k for k in fits if k[1] == r.text), fits[0])] += size(r.text)
    for k, n in taken.items():
        assert n <= 2 * given[k] * size(k[1])


def test_stages_keep_rows(spark, odd):
    count = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    clean = corpus_pipeline.remove_personal_data(spark, odd, "")
    assert clean.columns == list(corpus_pipeline.COLUMNS) and count(clean.collect()) == count(odd.collect())
    packed = Counter(p.doc_id for p in corpus_pipeline.pack_sequences(spark, odd, "").where("start = 0").collect())
    assert packed == Counter(r.doc_id for r in odd.collect())


def test_toxic_rows_go_by_text(spark, odd, tmp_path):
    labels = [(i, 1, int(i % 2)) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    left = corpus_pipeline.reject_toxic(spark, odd, f"file://{tmp_path}")
    assert left.columns == list(corpus_pipeline.COLUMNS)
    gone = Counter((r.doc_id, r.text) for r in odd.collect()) - Counter((r.doc_id, r.text) for r in left.collect())
    assert not {t for _, t in gone} & {r.text for r in left.collect()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, odd, stage, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert stage(spark, odd.limit(0), f"file://{tmp_path}").count() == 0


def test_personal_data_is_replaced(corpus):
    _, stages = corpus
    before, after = {r.doc_id: r for r in stages["near-duplicates"]}, {r.doc_id: r for r in stages["personal data"]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        old = before[i].text
        assert r.n_chars == (len(r.text) if r.text is not None else None) or r.text is None
        assert "@mail" not in (r.text or "") and ("[EMAIL]" in (r.text or "")) == ("@mail" in (old or ""))
        if "@mail" not in (old or ""):
            assert r.text == old


def test_mix_takes_effect(spark, corpus):
    path, stages = corpus
    frame = spark.createDataFrame(stages["personal data"], SCHEMA)
    taken = {r.doc_id: r for r in mixing.mix(frame).collect()}
    words, copies = Counter(), Counter()
    texts = {r.doc_id: r.text for r in stages["personal data"]}
    for r in stages["mixing"]:
        words[r.doc_id] += len((r.text or "").split())
        copies[r.doc_id] += 1
        assert (texts[r.doc_id] or "").startswith((r.text or "")[:200])
    for i, r in taken.items():
        assert words[i] == r.taken and copies[i] <= 2


def test_packing_covers_the_mix(corpus):
    _, stages = corpus
    by = Counter()
    for p in stages["packing"]:
        by[p.doc_id] += p.length
    assert set(by) == {r.doc_id for r in stages["mixing"]}
    sums = Counter()
    for p in stages["packing"]:
        sums[p.sequence_id] += p.length
    assert max(sums.values()) <= 2048 and sum(n == 2048 for n in sums.values()) >= len(sums) // 2


def test_run_equals_the_stages(spark, corpus):
    path, stages = corpus
    count = lambda rows: Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.sequence_id, p.offset) for p in rows)
    assert count(corpus_pipeline.run(spark, path).collect()) == count(stages["packing"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
