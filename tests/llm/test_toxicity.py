import numpy as np
import pytest

from chapterloom.llm import toxicity

CLEAN = "the river ran under an old bridge and then into the wide green valley where people were singing of better days".split()


@pytest.fixture(scope="module")
def decoder():
    text = "\n" + " ".join(CLEAN) + " idiot moron clown stupid people loser scum " * 20
    table = toxicity._classes()
    kinds = table[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(table) - 1)].astype(int)
    counts = np.bincount(kinds[:-1] * toxicity.CLASSES + kinds[1:], minlength=toxicity.CLASSES**2).reshape(toxicity.CLASSES, -1)
    return toxicity.Decoder(toxicity.language_model(counts))


def test_decoding(decoder):
    cases = {"1d10t": "idiot", "m0r0n!!": "moron", "c*l*o*w*n": "clown", "stuuuupid": "stupid", "$tup1d": "stupid", "people": "people", "***": "", "12345": "", "(loser)": "loser", "i.d.i.o.t": "idiot", "sc_um###": "scum"}
    assert {raw: decoder.word(raw) for raw in cases} == cases
    assert toxicity.spaced_words("so i d i o t is a b word".split()) == ["idiot"]
    assert decoder.word("x" * 50 + "_1d10t") .endswith("idiot")


def test_long_words_are_decoded(decoder):
    assert decoder.word("id" + "i" * 45 + "ot") == "idiot"
    joined = "$tup1d" * 8
    assert len(joined) > toxicity.LONG and decoder.word(joined).startswith("stupid") and " " not in decoder.word(joined)
    assert decoder.word("1d10t#" * 8).split() == ["idiot"] * 8
    assert decoder.word("x" * 100_000).startswith("x")


def test_viterbi_is_the_best_path(decoder):
    """Against all paths through short lattices."""

    def best(text):
        paths = [(0.0, toxicity.BOUNDARY, "")]
        for c in text:
            step = []
            for score, last, out in paths:
                own = decoder.number.get(c)
                options = [(own, toxicity.PLAIN)] if own is not None else [(decoder.number[x], toxicity.SWAPPED) for x in toxicity.STANDS_FOR.get(c, "")]
                for letter, cost in options:
                    step.append((score + cost + decoder.model[last][letter], letter, out + toxicity.LETTERS[letter]))
                    if letter == last:
                        step.append((score + toxicity.REPEATED, last, out))
                step.append((score + (toxicity.DROPPED_LETTER if c.isalpha() else toxicity.DROPPED), last, out))
            paths = step
        return max((s + decoder.model[last][toxicity.BOUNDARY], out) for s, last, out in paths)[1]

    for text in ("1d10t", "c|0wn", "sss+upid", "l0000ser", "a-1-!"):
        assert decoder._viterbi(text) == best(text)


def corpus(n=900):
    rng = np.random.default_rng(1)
    bad = ["idiot", "1d10t", "moron", "m0ron", "clown", "cl*wn", "Stuuupid", "i d i o t"]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(CLEAN, rng.integers(8, 60)))
        toxic = i % 6 == 0
        if toxic:
            for w in rng.choice(bad, 3):
                words.insert(int(rng.integers(0, len(words))), str(w))
        docs.append((i, " ".join(words), int(toxic), "x"))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    extra = [(10_000, None, 0, "x"), (10_001, "", 0, "x"), (10_002, "word " * 100_000, 0, "x"), (None, "the river", 0, "x"), (6, docs[6][1], 1, "x")]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, score int, kept string")
    truth = {i: t for i, _, t, _ in docs}
    marks = spark.createDataFrame([*labels, (None, 1, 1), (77_777, None, 0)], "doc_id long, toxic int, text int")
    found = toxicity.score(frame, marks).collect()
    assert len(found) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in found}
    assert by[10_000].score == by[10_001].score and not by[10_002].predicted


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(300)
    import zlib

    frame = spark.createDataFrame(docs, "doc_id long, text string, score int, kept string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, q) for i, t, q in labels]
    assert flipped != labels
    a, b = ({(r.doc_id, r.score) for r in toxicity.score(frame, spark.createDataFrame(x, "doc_id long, toxic int, q int")).collect()} for x in (labels, flipped))
    assert a == b


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 0
    one = toxicity.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), labels).collect()
    assert len(one) == 1 and one[0].score == pytest.approx(0.25)
