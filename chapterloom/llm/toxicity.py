"""Toxicity through a noisy channel: obfuscated words are decoded under a character language model, then scored.

1. A character bigram model is counted over all documents.
2. Words that show obfuscation (symbols or digits among letters, a letter three times in a row, letters spaced out) are
   read as character lattices: a character may stand for a letter (leetspeak), may be inserted noise, or may repeat the
   letter before it. Viterbi finds the likeliest letters.
3. Restored words are scored by a lexicon of words and word beginnings with their log-odds among labelled documents, and
   a logistic regression on each document's hits gives the probability.

Labels are used in 3. only, from at most `sample_rows` labelled rows that are not held out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäçèéêëíîïñóôöùúûüß"
#: The letters that a character may stand for.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
#: Channel log-probabilities.
PLAIN, SWAPPED, DROPPED, REPEATED, DROPPED_LETTER = math.log(0.9), math.log(0.08), math.log(0.04), math.log(0.05), -30.0
BOUNDARY = len(LETTERS)
CLASSES = BOUNDARY + 1
#: Lengths of the word beginnings that can be in the lexicon.
BEGINNINGS = range(3, 9)
#: A longer run of symbols and letters (an address, a key) is decoded between its characters without a letter reading.
LONG = 40
UNREAD = re.compile(r"[^" + LETTERS + re.escape("".join(STANDS_FOR)) + r"]+")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„…’‘¿¡–—"
#: Marks that can be a word's first letter when one of them stands before it.
FIRST = "$@!|+€£"
ODD = re.compile(r"[^" + LETTERS + r"]|(.)\1\1")
#: Words whose weights (features, in training) a worker remembers, and counts that it holds before it gives them on: bounds
#: on memory only, results do not depend on them.
CACHE_WORDS, CACHE_FEATURES, HELD_COUNTS = 200_000, 40_000, 100_000


# ---------------------------------------------------------------- character model


def _classes() -> np.ndarray:
    table = np.full(0x250, BOUNDARY, np.uint8)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i
        if len(c.upper()) == 1:
            table[ord(c.upper())] = i
    return table


def bigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring character classes over all texts: a fixed CLASSES x CLASSES table, summed in the cluster."""
    table = _classes()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in common.lean(batches):
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(at, 256).to_pylist()
                points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
                kinds = table[np.minimum(points, len(table) - 1)].astype(np.int32)
                total += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    rows = docs.select(common.text_or_empty().alias("text")).mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for r in rows:
        out[r.pair] = r.n
    return out.reshape(CLASSES, CLASSES)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(class | class before), add-one smoothed."""
    smooth = counts + 1.0
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- decoding


class Decoder:
    """Restores words of any length; pure Python, in time linear in the length, called once for each distinct odd word."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.number = {c: i for i, c in enumerate(LETTERS)}

    def word(self, raw: str) -> str:
        """The likeliest letters behind a lower-case word without white space; "" if nothing of it is a letter."""
        bare = raw.lstrip(EDGE)
        head, bare = raw[: len(raw) - len(bare)], bare.rstrip(EDGE)
        if len(head) == 1 and head in FIRST:
            bare = head + bare
        if not ODD.search(bare):
            return bare
        if not any(c.isalpha() for c in bare):
            return ""
        if len(bare) > LONG:
            parts = [part for part in UNREAD.split(bare) if any(c.isalpha() for c in part)]
            return " ".join(w for part in parts if (w := self._viterbi(part) if ODD.search(part) else part))
        return self._viterbi(bare)

    def _viterbi(self, text: str) -> str:
        model, number = self.model, self.number
        states: dict[int, tuple[float, tuple]] = {BOUNDARY: (0.0, ())}  # last letter: score, letters as a chain
        for c in text:
            reached: dict[int, tuple[float, tuple]] = {}

            def put(letter, score, chain, reached=reached):
                if letter not in reached or reached[letter][0] < score:
                    reached[letter] = (score, chain)

            own = number.get(c)
            options = [(own, PLAIN)] if own is not None else [(number[x], SWAPPED) for x in STANDS_FOR.get(c, "")]
            for last, (score, chain) in states.items():
                row = model[last]
                for letter, cost in options:
                    put(letter, score + cost + row[letter], (chain, letter))
                    if letter == last:
                        put(letter, score + REPEATED, chain)
                put(last, score + (DROPPED_LETTER if c.isalpha() else DROPPED), chain)
            states = reached
        _, chain = max(((s + self.model[last][BOUNDARY], ch) for last, (s, ch) in states.items()), key=lambda x: x[0])
        out = []
        while chain:
            chain, letter = chain
            out.append(LETTERS[letter])
        return "".join(reversed(out))


def spaced_words(words: list[str]) -> list[str]:
    """Runs of three or more words of one character each, joined: letters that were spaced out."""
    single = [i for i, w in enumerate(words) if len(w) == 1]
    out, run = [], []
    if len(single) >= 3:
        for i in [*single, -1]:
            if run and i != run[-1] + 1:
                if len(run) >= 3:
                    out.append("".join(words[run[0] : run[-1] + 1]))
                run = []
            run.append(i)
    return out


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f for w in word.split() for f in (w, *(w[:n] + "~" for n in BEGINNINGS if len(w) >= n))]


# ---------------------------------------------------------------- model


def held_out(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Scorer:
    """Document features from a lexicon {feature: weight}: words are looked up once and remembered."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float]):
        self.decoder, self.lexicon = Decoder(model), lexicon
        self.known: dict[str, float] = {}

    def weight(self, raw: str) -> float:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            word = self.decoder.word(raw.lower())
            found = self.known[raw] = max((self.lexicon[f] for f in features(word) if f in self.lexicon), default=0.0)
        return found

    def document(self, text: str) -> tuple[float, float, float, float]:
        """Words, hits, summed weight of hits, largest weight."""
        known = self.known
        words = text.split()
        weights = [known[w] if w in known else self.weight(w) for w in words]
        weights += [self.weight(w) for w in spaced_words(words)]
        hits = [w for w in weights if w]
        return float(len(weights)), float(len(hits)), sum(hits), max(hits, default=0.0)


def design(words: np.ndarray, hits: np.ndarray, total: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Columns of the regression: constant, hits, their rate, summed weight and its rate, and the largest weight."""
    n = np.maximum(words, 1.0)
    return np.stack([np.ones_like(n), np.log1p(hits), np.sqrt(hits / n), np.log1p(total), np.sqrt(total / n), most, np.log1p(n) / 10], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; columns are standardised and folded back."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w /= scale
    w[0] -= (w * mean)[1:].sum()
    return w


def _training(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """fold, label, text of at most about `sample_rows` labelled documents that are not held out, chosen by a hash of the id."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    total = marked.count()
    part = F.pmod(F.xxhash64("l_id", F.lit(seed)), F.lit(1_000_000))
    if total > sample_rows:
        marked = marked.where(part < int(1_000_000 * sample_rows / total))
    plain = docs.select(F.col("doc_id").cast("long").alias("d_id"), common.text_or_empty().alias("text"))
    # About `sample_rows` rows of two numbers at most, so texts stay where they are.
    return plain.join(F.broadcast(marked), F.col("l_id") == F.col("d_id")).select(F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "label", "text")


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, lexicon_size: int = 4_000, min_weight: float = 2.0, seed: int = 5) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """(character model, lexicon, regression weights).

    The lexicon is counted in the cluster over the sampled training rows. Regression columns of a training row come from
    the lexicon of the other half of the rows (equal texts fall in the same half), so they look as for unseen documents.
    """
    model = language_model(bigram_counts(docs))
    training = common.materialise(_training(docs, labels, sample_rows, seed), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, memo, counts = Decoder(model), {}, {}
        for batch in common.lean(batches):
            for fold, label, text in zip(batch.column("fold").to_pylist(), batch.column("label").to_pylist(), batch.column("text"), strict=True):
                found = set()
                words = text.as_py().split()
                for raw in {*words, *spaced_words(words)}:
                    if raw not in memo:
                        if len(memo) > CACHE_FEATURES:
                            memo.clear()
                        memo[raw] = features(decoder.word(raw.lower()))
                    found.update(memo[raw])
                for f in found:
                    key = (fold, f)
                    at = counts.get(key)
                    if at is None:
                        at = counts[key] = [0, 0]
                    at[1 if label else 0] += 1
                if len(counts) > HELD_COUNTS:
                    yield _counts(counts)
                    counts = {}
        yield _counts(counts)

    sums = training.mapInArrow(counted, "fold int, feature string, clean long, toxic long").groupBy("feature", "fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {(r.fold, r.label): r.n for r in training.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Per feature its counts in either fold; only features with toxic documents can have a weight above zero.
    wide = sums.groupBy("feature").agg(*(F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("clean", "toxic")))
    best = wide.where(F.col("toxic0") + F.col("toxic1") >= 3).withColumn("ratio", (F.col("toxic0") + F.col("toxic1")) / (F.col("clean0") + F.col("clean1") + 1.0))
    rows = best.orderBy(F.desc(F.least(F.col("toxic0") + F.col("toxic1"), F.lit(20)) * F.col("ratio")), "feature").limit(lexicon_size).collect()
    n = {k: [max(1, totals.get((k, c), 0)) for c in (0, 1)] for k in (0, 1)}

    def weights(folds: tuple[int, ...]) -> dict[str, float]:
        clean, toxic = sum(n[k][0] for k in folds), sum(n[k][1] for k in folds)
        out = {}
        for r in rows:
            a, b = sum(r[f"toxic{k}"] for k in folds), sum(r[f"clean{k}"] for k in folds)
            # A cautious estimate of the log-odds: a deviation off the toxic rate, smoothed on the clean side.
            w = math.log((max(0.0, a - math.sqrt(a)) + 1e-3) / toxic) - math.log((b + 1.0) / clean)
            if a >= (2 if len(folds) == 1 else 3) and w >= min_weight:
                out[r["feature"]] = round(w, 6)
        return out

    halves = (weights((1,)), weights((0,)))  # for the documents of fold 0, and of fold 1

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(model, x) for x in halves]
        for batch in common.lean(batches):
            got = [scorers[k].document(t.as_py()) for k, t in zip(batch.column("fold").to_pylist(), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([g[i] for g in got], pa.float64()) for i in range(4))], names=["label", "words", "hits", "total", "most"])

    seen = training.mapInArrow(measured, "label int, words double, hits double, total double, most double").toPandas()
    if seen["label"].nunique() < 2:  # nothing to learn from: every score is the rate of the label, smoothed
        rate = (seen["label"].sum() + 0.5) / (len(seen) + 2.0)
        return model, {}, np.array([math.log(rate / (1 - rate)), 0, 0, 0, 0, 0, 0])
    seen = seen.sort_values(list(seen.columns))
    fitted = logistic(design(*(seen[c].to_numpy() for c in ("words", "hits", "total", "most"))), seen["label"].to_numpy(float))
    return model, weights((0, 1)), fitted


def _counts(counts: dict) -> pa.RecordBatch:
    keys, values = list(counts), list(counts.values())
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["fold", "feature", "clean", "toxic"])


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, keep: tuple[str, ...] = (), **fitting) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 from `threshold`), hits, then the columns named in `keep`.

    Args:
        docs: doc_id long, text string; labels: doc_id long, toxic int. Other columns are not used; those of docs that are
            named in `keep` are passed through. `fitting` goes to `fit`, whose `sample_rows` bounds the labelled sample.
    A null text counts as empty and gets the score of a document without hits. Repeated rows are scored alike. Without
    usable labels every score is the same, 0.25. An empty table gives no rows.
    """
    common.text_batches(docs.sparkSession)
    model, lexicon, fitted = fit(docs, labels, **fitting)
    mark = zlib.crc32(repr((sorted(lexicon.items()), fitted.tolist())).encode())
    plain = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), *keep).alias("kept"), common.text_or_empty().alias("scored_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.held(("scorer", mark), lambda: Scorer(model, lexicon))
        for batch in common.lean(batches):
            got = np.array([scorer.document(t.as_py()) for t in batch.column("scored_text")], float).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(design(*got.T) @ fitted, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(p), pa.array(got[:, 1].astype(np.int64))], names=["kept", "score", "hits"])

    schema = plain.select("kept").schema.add("score", "double").add("hits", "long")
    out = plain.mapInArrow(scored, schema)
    return out.select("kept.doc_id", "kept.held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits", *(f"kept.{c}" for c in keep))
