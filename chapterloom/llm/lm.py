"""Masked pseudo-likelihood scoring: a bidirectional window network, trained in numpy on all documents.

The network predicts every token from the two tokens on either side: their embeddings, scaled by position, are summed
and squashed, and a two-level softmax (class of tokens, then member of the class) gives log P(token | both sides). The
sum over a document is its pseudo-log-likelihood.

Training: all partitions start from one set of parameters; each takes its own documents through the network once and
gives its parameters weighted by its tokens; they are averaged in the cluster, number by number. The driver gets the
vocabulary and the averaged parameters, whose sizes do not depend on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES = MEMBERS = 64
VOCABULARY = CLASSES * MEMBERS
#: Numbers for tokens outside the vocabulary (by hash), and one for what lies outside the document.
UNKNOWN, OUTSIDE = 64, 0
WIDTH = 16
WINDOW = (-2, -1, 1, 2)
#: Tokens of a learning step, and of a scoring step.
BATCH, SCORED = 16_384, 32_768
SHAPES = {"embedding": (VOCABULARY, WIDTH), "position": (len(WINDOW), WIDTH), "bias": (WIDTH,), "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,), "to_member": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
EDGE = ".,;:!?\"'()[]{}|%&$*#-_«»“”„…"


def words(text: str) -> list[str]:
    """Lower-cased words between white space, without marks at their ends; words of marks alone stay whole."""
    return [w.strip(EDGE) or w for w in text.lower().split()]


def word(raw: str) -> str:
    """The word of one run between white space."""
    low = raw.lower()
    return low.strip(EDGE) or low


class Network:
    """Parameters, loss and Adagrad steps."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {k: np.array(v, np.float32) for k, v in parameters.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    @staticmethod
    def initial(counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
        """Small random weights; output biases from the corpus counts."""
        rng = np.random.default_rng(seed)
        p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
        p["position"] = (1 + rng.normal(0, 0.1, SHAPES["position"])).astype(np.float32)
        shares = (counts + 1.0).reshape(CLASSES, MEMBERS)
        p["bias"][:] = 0
        p["class_bias"] = np.log(shares.sum(axis=1) / shares.sum()).astype(np.float32)
        p["member_bias"] = np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
        return p

    def forward(self, context: np.ndarray, target: np.ndarray, learn: float = 0.0) -> np.ndarray:
        """log P of each target from its context (n x 4); with `learn`, an Adagrad step of that rate follows."""
        p = self.p
        n = len(target)
        hidden = p["bias"] + sum(np.take(p["embedding"] * p["position"][w], context[:, w], axis=0) for w in range(len(WINDOW)))
        np.tanh(hidden, out=hidden)
        kind, member = np.divmod(target, MEMBERS)
        # Biases ride along as the weights of a constant, so a product gives the logits.
        hidden = np.concatenate((hidden, np.ones((n, 1), np.float32)), axis=1)
        to_class = np.concatenate((p["to_class"], p["class_bias"][None, :]))
        to_member = np.concatenate((p["to_member"], p["member_bias"][:, None, :]), axis=1)
        out, soft = _log_softmax(hidden @ to_class, kind, bool(learn), _bounded(to_class))
        bounded = _bounded(to_member.transpose(1, 0, 2).reshape(WIDTH + 1, -1))
        order = np.argsort(kind.astype(np.int16), kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        own, members = hidden[order], member[order]
        picked = np.empty(n, np.float32)
        grads = {}
        if learn:
            soft[np.arange(n), kind] -= 1
            grads = {k: np.zeros_like(p[k]) for k in ("embedding", "position", "to_member", "member_bias")}
            both = hidden.T @ soft
            grads["to_class"], grads["class_bias"] = both[:WIDTH], both[WIDTH]
            back = np.take(soft @ p["to_class"].T, order, axis=0)
        for c in range(CLASSES):
            low, high = cuts[c], cuts[c + 1]
            if low < high:
                rows = own[low:high]
                picked[low:high], soft = _log_softmax(rows @ to_member[c], members[low:high], bool(learn), bounded)
                if learn:
                    soft[np.arange(high - low), members[low:high]] -= 1
                    both = rows.T @ soft
                    grads["to_member"][c], grads["member_bias"][c] = both[:WIDTH], both[WIDTH]
                    back[low:high] += soft @ p["to_member"][c].T
        out[order] += picked
        if learn:
            back *= 1 - own[:, :WIDTH] ** 2
            grads["bias"] = back.sum(axis=0)
            for w in range(len(WINDOW)):
                # Sums of the error by context token serve the embeddings and the position's scale alike.
                tokens, sums = _summed(context[order, w], back)
                grads["embedding"][tokens] += sums * p["position"][w]
                grads["position"][w] = (p["embedding"][tokens] * sums).sum(axis=0)
            for k, g in grads.items():
                g = np.clip(g / np.float32(n) ** 0.5, -5, 5)
                self.squares[k] += g * g
                p[k] -= np.float32(learn) * g / np.sqrt(self.squares[k])
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _bounded(weights: np.ndarray) -> bool:
    """Whether no input within -1 to 1 can give a logit beyond 60, so that exponentials stay finite."""
    return bool(np.abs(weights).sum(axis=0).max() < 60)


def _log_softmax(logits: np.ndarray, chosen: np.ndarray, all_: bool, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """log-probability of `chosen`; with `all_` also all probabilities."""
    if not bounded:
        np.clip(logits, -60, 60, out=logits)
    picked = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], np.float32)
    if all_:
        logits /= sums[:, None]
    return picked - np.log(sums), logits


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, sums of their rows)."""
    order = np.argsort(keys.astype(np.int16), kind="stable")
    sorted_ = keys[order]
    heads = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1))
    return sorted_[heads], np.add.reduceat(np.take(rows, order, axis=0), heads, axis=0)


def _hashed(w: str) -> int:
    """The number of a word outside the vocabulary."""
    return 1 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % UNKNOWN


class Numbering:
    """Texts to numbers. Words as they stand are remembered (a bound on memory only); those outside the vocabulary have
    the number of their hash."""

    def __init__(self, vocabulary: dict[str, int], remembered: int = 400_000):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.known: dict[str, int] = {}

    def _new(self, raw: str) -> int:
        w = word(raw)
        n = self.vocabulary.get(w)
        if n is None:
            n = _hashed(w)
        if len(self.known) >= self.remembered:
            self.known.clear()
        self.known[raw] = n
        return n

    def __call__(self, text: str) -> np.ndarray:
        known, new = self.known, self._new
        return np.array([known[w] if w in known else new(w) for w in text.split()], np.int32)


def windows(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(context, target) of all tokens; what lies outside a document is OUTSIDE."""
    gap = np.zeros(2, np.int32)
    stream = np.concatenate([gap, *(x for d in documents for x in (d, gap))])
    inside = np.concatenate([np.zeros(2, bool), *(x for d in documents for x in (np.ones(len(d), bool), np.zeros(2, bool)))])
    at = np.flatnonzero(inside)
    return np.stack([stream[at + w] for w in WINDOW], axis=1), stream[at]


def vocabulary(docs: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """({word: number}, counts by number, log of the different words by number): the most frequent words of all documents,
    ties in code-point order; how many words each number outside the vocabulary stands for is counted over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            merged: Counter = Counter()
            for raw, n in counts.items():
                merged[word(raw)] += n
            return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["word", "n"])

        for batch in common.lean(batches):
            for text in batch.column("text").to_pylist():
                counts.update(text.split())
            if len(counts) > 300_000:
                yield given()
                counts.clear()
        yield given()

    sums = docs.select(common.text_or_empty().alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = common.materialise(sums, "lm-words")
    first = UNKNOWN + 1
    top = sums.orderBy(F.desc("n"), F.col("word").cast("binary")).limit(VOCABULARY - first).collect()
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = np.zeros(VOCABULARY)
    for i, r in enumerate(top):
        counts[first + i] = r.n
    counts[1:first] = max(0, total - counts.sum()) / UNKNOWN
    known = {r.word: first + i for i, r in enumerate(top)}
    shared = np.zeros(VOCABULARY)
    for r in sums.groupBy((1 + F.crc32(F.col("word").cast("binary")) % UNKNOWN).alias("number")).agg(F.count(F.lit(1)).alias("words")).collect():
        shared[r.number] = r.words
    for w in known:
        shared[_hashed(w)] -= 1
    return known, counts, np.log(np.maximum(shared, 1))


def numbered(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """doc_id, ids (two bytes a token) of every document, written: training and scoring read these, not the texts."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbering(known)
        for batch in common.lean(batches):
            ids = [number(t).astype("<i2").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return common.materialise(plain.mapInArrow(marked, "doc_id long, ids binary"), "lm-ids")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2").astype(np.int32)


def train(ids: DataFrame, counts: np.ndarray, *, rate: float = 0.1) -> dict[str, np.ndarray]:
    """Averaged parameters after one pass of every partition of `numbered` documents over its own."""
    start = Network.initial(counts)
    size = sum(int(np.prod(s)) for s in SHAPES.values())

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen, open_, held = Network(start), 0, [], 0

        def learn() -> int:
            context, target = windows(open_)
            for at in range(0, len(target), BATCH):
                network.forward(context[at : at + BATCH], target[at : at + BATCH], learn=rate)
            return len(target)

        for batch in common.lean(batches):
            for raw in batch.column("ids").to_pylist():
                open_.append(_ids(raw))
                held += len(open_[-1])
                if held >= 4 * BATCH:
                    seen += learn()
                    open_, held = [], 0
        if held:
            seen += learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([network.flat()], pa.list_(pa.float32()))], names=["seen", "flat"])

    models = ids.select("ids").mapInArrow(trained, "seen long, flat array<float>")
    models = common.materialise(models, "lm-models")
    seen = models.agg(F.sum("seen")).first()[0]
    if not seen:
        return start
    share = F.col("value").cast("double") * F.col("seen") / float(seen)
    rows = models.select("seen", F.posexplode("flat").alias("at", "value")).groupBy("at").agg(F.sum(share).alias("value")).collect()
    flat = np.zeros(size)
    for r in rows:
        flat[r["at"]] = r["value"]
    return unflat(flat)


def score(docs: DataFrame, **training) -> DataFrame:
    """One row a document: doc_id, n_tokens, log_likelihood (summed), mean_log_likelihood, perplexity.

    Args:
        docs: doc_id long, text string; other columns are ignored, whatever their names.
    A word outside the vocabulary is predicted by its hashed number and an equal share of that number's probability for each
    of its words in the corpus, so it costs as much as they are many.
    A null text and a text without words have no tokens, log-likelihood 0, and null mean and perplexity. Repeated rows
    are scored alike. An empty table gives no rows. Figures are rounded to four places, as sums over partitions can
    differ in their last digits.
    """
    common.text_batches(docs.sparkSession)
    known, counts, shared = vocabulary(docs)
    ids = numbered(docs, known)
    parameters = train(ids, counts, **training)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(parameters)
        for whole in common.lean(batches):
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                documents = [_ids(raw) for raw in batch.column("ids").to_pylist()]
                context, target = windows(documents)
                parts = [network.forward(context[i : i + SCORED], target[i : i + SCORED]).astype(np.float64) for i in range(0, len(target), SCORED)]
                logs = np.concatenate([*parts, np.zeros(1)])
                logs[: len(target)] -= shared[target]
                lengths = np.array([len(d) for d in documents])
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths.astype(np.int64)), pa.array(sums[ends] - sums[ends - lengths])], names=["doc_id", "n_tokens", "log_likelihood"])

    out = ids.mapInArrow(scored, "doc_id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", F.round("log_likelihood", 4).alias("log_likelihood"), F.round(mean, 4).alias("mean_log_likelihood"), F.round(F.exp(-mean), 4).alias("perplexity"))
