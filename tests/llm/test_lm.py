import numpy as np
import pytest

from chapterloom.llm import lm


def toy():
    counts = np.ones(lm.VOCABULARY)
    return lm.Network(lm.Network.initial(counts))


def test_two_level_softmax_is_a_distribution():
    network = toy()
    context = np.tile(np.array([[70, 3, 0, 99]], np.int32), (lm.VOCABULARY, 1))
    logs = network.forward(context, np.arange(lm.VOCABULARY, dtype=np.int32))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1.0, abs=1e-3)


def test_gradient_direction():
    network = toy()
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 200, (400, 4)).astype(np.int32), rng.integers(0, 200, 400).astype(np.int32)
    before = network.forward(context, target).mean()
    for _ in range(30):
        network.forward(context, target, learn=0.1)
    assert network.forward(context, target).mean() > before + 1


def test_windows():
    context, target = lm.windows([np.array([5, 6, 7], np.int32), np.array([], np.int32), np.array([9], np.int32)])
    assert target.tolist() == [5, 6, 7, 9]
    assert context.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_scores(spark):
    rng = np.random.default_rng(1)
    heads, tails = [f"h{i}" for i in range(30)], [f"t{i}" for i in range(30)]
    say = lambda: " ".join(f"{heads[i]} {tails[i]} {tails[(i + 1) % 30]}" for i in rng.integers(0, 30, 60))
    train = [(i, say(), "x", 0.0) for i in range(400)]
    held = say()
    mixed = " ".join(rng.permutation(held.split()))
    odd = [(1000, held, "", 0.0), (1001, mixed, "", 0.0), (1002, None, "", 0.0), (1003, "  ", "", 0.0), (1004, "new unseen words", "", 0.0), (None, "h1 t1", "", 0.0), (1000, held, "", 0.0), (1005, "h1 " * 60_000, "", 0.0)]
    frame = spark.createDataFrame(train + odd, "doc_id long, text string, n_tokens string, seen double")
    found = lm.score(frame).collect()
    assert len(found) == len(train) + len(odd)
    by = {r.doc_id: r for r in found}
    assert by[1000].mean_log_likelihood > by[1001].mean_log_likelihood + 0.3
    assert by[1002].n_tokens == by[1003].n_tokens == 0 and by[1002].log_likelihood == 0 and by[1002].perplexity is None
    assert by[1000].n_tokens == 180 and by[1000].log_likelihood == pytest.approx(180 * by[1000].mean_log_likelihood, abs=0.02)


def test_batches_do_not_change_scores():
    network = toy()
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 4096, (300, 4)).astype(np.int32), rng.integers(0, 4096, 300).astype(np.int32)
    whole = network.forward(context, target)
    parts = np.concatenate([network.forward(context[i : i + 7], target[i : i + 7]) for i in range(0, 300, 7)])
    assert np.allclose(whole, parts, atol=1e-4)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
