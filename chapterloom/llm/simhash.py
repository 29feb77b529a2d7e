"""SimHash near-duplicates: fingerprints over word shingles, linked by deletion-variant signatures.

Each 64-bit word of a fingerprint is cut into three segments. Two fingerprints that differ little differ by at most one
bit in some segment (with one word, up to five differing bits make that certain), so they share a one-wildcard variant
of it: the segment with the differing bit, or any bit, left out. Variants are joined by equality, and a joined pair is
verified by all bits and, if `similarity` is given, by the share of shingles that the texts have in common.

Where variants meet. A wildcard in one half of a segment leaves the other half as it is. So a fingerprint is sent to two
places for each segment, one for each half that stays, and the variants with their wildcard in the other half are indexed
and joined there. That moves 6 rows a fingerprint word instead of 64, and finds the same pairs.

Scale. Equal fingerprints (or texts) are one node, so copies cost nothing. A place with more than PLACE nodes is dealt
into pairs of blocks, each a task's group of its own. Where many nodes share a variant (near copies of one text), they are
linked to the smallest one first; what is then still in different components is compared in a second search of such
places, which skips what is connected. So neither copies nor near copies make all pairs, and no link is lost.

Pairs that share too little. In a large group most pairs that the second search compares can have too few shingles in
common, though their bits differ little. There a node brings the parities of its shingles: each shingle flips one bit of
PARITY. Sets differ by at least as many shingles as their parities differ in bits, so a pair whose parities differ by more
than its similarity allows is dropped where it is found, and no pair that has the similarity is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

DISTANCE = 4
#: (shift, bits) of the three segments of a word.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Bits of a segment's lower half.
LOWER = 10
#: Nodes of a place that are one group; more are dealt into pairs of blocks.
PLACE = 20_000
#: Pairs of nodes with one variant beyond which they are linked by way of the smallest one first.
DENSE = 2_000
#: Links of a node to smaller ones that a task gives at first; where it has more, they count as dense too.
THIN = 2
#: Rows that a task gathers before it joins variants (whole groups), and pairs that it verifies at a time.
GATHERED, VERIFIED = 60_000, 1 << 18
#: Rows of a table that may be broadcast: a number or two and a digest each, so about 10 MB.
BROADCAST_ROWS = 100_000
#: Bits of a text's parities, a power of two.
PARITY = 1024


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words, repeats included; fewer words: of all; none: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _again(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other 64 bits of the same shingles: the hashes multiplied and mixed anew."""
    h = hashes * np.uint64((2 * number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def signature(hashes: np.ndarray, words: int) -> tuple[int, ...]:
    """`words` numbers of 64 bits; the first is the majority of the hashes themselves."""
    return tuple(majority(hashes if i == 0 else _again(hashes, i)) for i in range(words))


def parities(different: np.ndarray) -> bytes:
    """PARITY bits: each tells whether an odd number of the different hashes falls on it."""
    on = np.bincount((different & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((on & 1).astype(np.uint8)).tobytes()


def fingerprint(text: str, shingle: int = 4, words: int = 1) -> tuple[int, ...]:
    """The signature of a text's word shingles."""
    return signature(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """kept (doc_id and the columns named in `keep`), class (MD5 of the text), n (different shingles), parity (of those), fp0,
    fp1, ... for every row of docs (doc_id long, text string); null text: empty."""
    names = [f"fp{i}" for i in range(words)]
    common.text_batches(docs.sparkSession)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.lean(batches):
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found, different, parity = np.zeros((batch.num_rows, words), np.uint64), np.zeros(batch.num_rows, np.int32), []
                for row, text in enumerate(batch.column("text")):
                    hashes = shingle_hashes(text.as_py(), shingle)
                    once = np.unique(hashes)
                    found[row], different[row] = signature(hashes, words), len(once)
                    parity.append(parities(once))
                columns = [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(words)]
                yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("class"), pa.array(different), pa.array(parity, pa.binary()), *columns], names=["kept", "class", "n", "parity", *names])

    text = common.text_or_empty()
    plain = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *keep).alias("kept"), F.md5(text.cast("binary")).alias("class"), text.alias("text"))
    schema = plain.select("kept", "class").schema.add("n", "integer").add("parity", "binary")
    for name in names:
        schema = schema.add(name, "long")
    return plain.mapInArrow(marked, schema)


# ---------------------------------------------------------------- the variant index


def _halves() -> list[tuple[int, int, int]]:
    """(shift, bits, shift of the whole) of each half of each segment, lower halves first in a segment."""
    return [h for shift, bits in SEGMENTS for h in ((shift, LOWER, shift), (shift + LOWER, bits - LOWER, shift))]


def _spots(words: int) -> Column:
    """Where a fingerprint's variants lie: number of the half that stays, its value, value of the half with the wildcard. The
    first two are the place."""
    out = []
    halves = _halves()
    value = lambda w, half: F.shiftrightunsigned(F.col(f"fp{w}"), half[0]).bitwiseAND(F.lit((1 << half[1]) - 1)).cast("int")
    for w in range(words):
        for number in range(len(halves)):
            out.append(F.lit((w * len(halves) + number) << 24) + F.shiftleft(value(w, halves[number]), 12) + value(w, halves[number ^ 1]))
    return F.array(*out)


def first_shared(different: np.ndarray) -> np.ndarray:
    """For differences of fingerprints (pairs x words), the number of the first half at whose place the pair is found."""
    out = np.full(len(different), 1 << 10, np.int64)
    for w in range(different.shape[1] - 1, -1, -1):
        for seg in range(len(SEGMENTS) - 1, -1, -1):
            shift, bits = SEGMENTS[seg]
            part = (different[:, w] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            lower = part & np.uint64((1 << LOWER) - 1)
            number = w * 2 * len(SEGMENTS) + 2 * seg
            out = np.where(np.bitwise_count(part) <= 1, np.where(lower != 0, number + 1, number), out)
    return out


def _pairs(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions of left range x right range, range by range, about VERIFIED at a time."""
    rows = np.maximum(1, VERIFIED // np.maximum(right_size, 1))  # of a left range at a time
    parts = -(-left_size // rows)
    piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    left, whole, right, right_size, rows = (np.repeat(x, parts) for x in (left, left_size, right, right_size, rows))
    left, left_size = left + piece * rows, np.minimum(rows, whole - piece * rows)
    held = left_size * right_size
    at = 0
    while at < len(held):
        to = at + max(1, int(np.searchsorted(np.cumsum(held[at:]), VERIFIED, side="right")))
        sizes = held[at:to]
        which = np.repeat(np.arange(at, to), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield left[which] + inside // right_size[which], right[which] + inside % right_size[which]
        at = to


def joined(group: np.ndarray, spot: np.ndarray, node: np.ndarray, root: np.ndarray, block: np.ndarray, prints: np.ndarray, n: np.ndarray, distance: int, similarity: float, all_pairs: bool, parity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, positions, dense spots): the verified pairs that share a variant, each at the first place it does.

    Args:
        group: number of the group of each row, ascending; block: 0 or 1, of which side of a pair of blocks the row is
            (2: of a group that is not dealt).
        prints: rows x words; n: their different shingles. Of a pair the smaller must be `similarity` of the larger or more.
            Pairs under one root are left out. Unless `all_pairs`, the pairs of nodes that have more than DENSE of them under
            one variant, or between two, are those of their smallest nodes, and their spots are reported.
        parity: rows x words of the parities of their shingles; pairs that these show to lack the similarity are left out.
    """
    number, wild = (spot >> 24).astype(np.int64), (spot & 0xFFF).astype(np.int64)
    half = number % len(_halves())
    bits = np.array([h[1] for h in _halves()])[half ^ 1]  # of the half with the wildcard
    key = group.astype(np.int64) << 12 | wild
    _, kin = np.unique(root, return_inverse=True)
    order = np.lexsort((node, kin, key))
    key, kin, half, bits = key[order], kin[order], half[order], bits[order]
    edge = np.concatenate(([True], key[1:] != key[:-1]))
    head = np.flatnonzero(edge)  # runs: nodes with equal variants whatever the wildcard
    size = np.diff(np.append(head, len(key)))
    inner = np.flatnonzero(edge | np.concatenate(([True], kin[1:] != kin[:-1])))  # parts of runs: nodes under one root
    inner_size = np.diff(np.append(inner, len(key)))
    run = np.cumsum(edge)[inner] - 1
    before = inner - head[run]
    asked: list[tuple] = []  # ranges to the left and right; whether they stand for more
    dense = np.zeros(len(head), bool)
    # Equal segments: every part of a run with the parts before it; taken at the lower half's place only.
    lower = half % 2 == 0
    once = lower[inner] & (before > 0)
    if not all_pairs:
        pairs_of = np.bincount(run, weights=inner_size * before, minlength=len(head))
        dense = (pairs_of > DENSE) & lower[head]
        rest = once & dense[run]
        once &= ~dense[run]
        asked.append((inner[rest], inner_size[rest], head[run[rest]], np.ones(int(rest.sum()), np.int64), True))
    asked.append((inner[once], inner_size[once], head[run[once]], before[once], False))
    # Segments with one differing bit: every part of a run with the run that has that bit set, but for its own root's part.
    span = len(np.unique(kin))
    both = key[inner] * span + kin[inner]
    for b in range(int(bits.max(initial=0))):
        open_ = np.flatnonzero(((key[inner] >> b) & 1 == 0) & (b < bits[inner]))
        at = np.searchsorted(key[head], key[inner[open_]] | 1 << b)
        hit = (at < len(head)) & (key[head[np.minimum(at, len(head) - 1)]] == key[inner[open_]] | 1 << b)
        mine, at = open_[hit], at[hit]
        if not len(mine):
            continue
        if not all_pairs:
            thick = size[run[mine]] * size[at] > DENSE
            dense[run[mine[thick]]] = dense[at[thick]] = True
            asked.append((inner[mine[thick]], np.ones(int(thick.sum()), np.int64), head[at[thick]], np.ones(int(thick.sum()), np.int64), True))
            mine, at = mine[~thick], at[~thick]
        same = key[head[at]] * span + kin[inner[mine]]
        low = np.searchsorted(both, same)
        found = (low < len(both)) & (both[np.minimum(low, len(both) - 1)] == same)
        stop = np.where(found, inner[np.minimum(low, len(inner) - 1)], head[at] + size[at])
        go = np.where(found, stop + inner_size[np.minimum(low, len(inner) - 1)], stop)
        asked.append((inner[mine], inner_size[mine], head[at], stop - head[at], False))
        asked.append((inner[mine], inner_size[mine], go, head[at] + size[at] - go, False))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for *ranges, stands in asked:
        for a, b in _pairs(*ranges):
            a, b = order[a], order[b]
            different = prints[a] ^ prints[b]
            far = np.bitwise_count(different).sum(axis=1, dtype=np.int32)
            good = (far <= distance) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])) & (root[a] != root[b]) & ((block[a] != block[b]) | (block[a] == 2))
            if parity is not None:
                x, y = a[good], b[good]
                good[good] = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int32) <= allowed(n[x].astype(np.int64) + n[y], similarity)
            if not stands:  # at its first place a pair is given, or its spots are reported: the second search finds it there
                good[good] = first_shared(different[good]) == number[a[good]]
            left.append(a[good])
            right.append(b[good])
    return np.concatenate(left), np.concatenate(right), np.unique(spot[order[head[dense]]])


def allowed(both: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles can be in one only of two sets of so many together that have the similarity."""
    return both * (1 - similarity) / (1 + similarity) + 1e-6


def thinned(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which pairs stay: of a node's different links to smaller ones THIN, the smallest."""
    order = np.lexsort((low, high))
    l, h = low[order], high[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    step = new | np.concatenate(([True], l[1:] != l[:-1])) if len(h) else new
    different = np.cumsum(step)
    rank = different - np.maximum.accumulate(np.where(new, different, 0)) if len(h) else different
    stay = np.zeros(len(h), bool)
    stay[order] = rank < THIN
    return stay


def search(nodes: DataFrame, *, words: int, distance: int, similarity: float = 0.0, spots: DataFrame | None = None, all_pairs: bool = False) -> DataFrame:
    """a, b, at: pairs of nodes under different roots that share a variant and differ by at most `distance` bits, each
    once or more; and, with null a and b, the spots at which dense nodes were linked by way of the smallest.

    Args:
        nodes: node long, root long, n int, fp0 long, ..., and parity binary if there is a similarity; one row a node.
        spots: if given, only these (at int) are searched.
        all_pairs: whether dense nodes are compared in pairs too.
    """
    spark = nodes.sparkSession
    prints = [f"fp{i}" for i in range(words)]
    more = ["parity"] if all_pairs and similarity else []
    dealt = nodes.select("node", "root", "n", *prints, *more, F.explode(_spots(words)).alias("spot"))
    if spots is not None:
        side = F.broadcast(spots) if spots.count() <= BROADCAST_ROWS else spots
        dealt = dealt.join(side, F.col("spot") == F.col("at"), "left_semi")
    dealt = dealt.withColumn("place", F.shiftrightunsigned("spot", 12))
    hot = dealt.groupBy(F.col("place").alias("h_place")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PLACE)
    hot = common.materialise(hot.select("h_place", F.ceil(F.col("n") / PLACE).cast("int").alias("blocks")), "simhash-hot")
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = dealt.join(side, F.col("place") == F.col("h_place"), "left").withColumn("own", own)
        dealt = dealt.withColumn("x", F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
        dealt = dealt.withColumns({"i": F.coalesce(F.least("own", "x"), F.lit(0)), "j": F.coalesce(F.greatest("own", "x"), F.lit(0))})
        dealt = dealt.withColumn("block", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("own") == F.col("j")).cast("int")).cast("int"))
    else:
        dealt = dealt.withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(2)})
    columns = ["place", "i", "j", "block", "spot", "node", "root", "n", *prints]
    dealt = dealt.select(*columns, *more).repartition(common.shuffle_partitions(spark), "place", "i", "j").sortWithinPartitions("place", "i", "j")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def given(rows: list[np.ndarray]) -> pa.RecordBatch:
            place, i, j, block, spot, node, root, n, *fps = rows[: len(columns)]
            new = (place[1:] != place[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.concatenate(([0], np.cumsum(new)))
            a, b, at = joined(group, spot, node, root, block, np.stack(fps, axis=1).view(np.uint64), n, distance, similarity, all_pairs, *rows[len(columns) :])
            low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            if not all_pairs:
                stay = thinned(low, high)
                at = np.unique(np.concatenate((at, spot[a[~stay]], spot[b[~stay]])))
                low, high = low[stay], high[stay]
            a, b = np.unique(np.stack((low, high)), axis=1)
            none = np.zeros(len(at), np.int64)
            mask = np.arange(len(a) + len(at)) >= len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, none)), mask=mask), pa.array(np.concatenate((b, none)), mask=mask), pa.array(np.concatenate((np.zeros(len(a), np.int32), at.astype(np.int32))), mask=~mask)], names=["a", "b", "at"])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            held[-1] += [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in more]
            if sum(len(x[0]) for x in held) < GATHERED:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield given([c[:cut] for c in rows])
            held = [[c[cut:] for c in rows]]
        if held and sum(len(x[0]) for x in held):
            yield given([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(found, "a long, b long, at int")


# ---------------------------------------------------------------- verification by shingles


def shingle_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """node, held: the different shingle hashes of the text of each of `classes` (node, class)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.lean(batches):
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                held = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column("text")]
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))], names=["node", "held"])

    text = common.text_or_empty()
    texts = docs.select(F.md5(text.cast("binary")).alias("t_class"), text.alias("text"))
    side = F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes
    wanted = texts.join(side, F.col("t_class") == F.col("class")).groupBy("node").agg(F.first("text").alias("text"))
    return wanted.mapInArrow(cut, "node long, held array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of `similarity` or more."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    x, y = F.size("x"), F.size("y")
    alike = F.size(F.array_intersect("x", "y")) * (1 + similarity) >= similarity * (x + y) - 1e-9
    return both.where((F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & alike).select("a", "b")


# ---------------------------------------------------------------- the operator


class _Links:
    """Finds and verifies links. Shingle sets are made once for a node; `tables` are what can go when all links are known."""

    def __init__(self, docs: DataFrame, shingle: int, words: int, distance: int, similarity: float | None):
        self.docs, self.shingle, self.words, self.distance, self.similarity = docs, shingle, words, distance, similarity
        self.sets: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        self.tables.append(common.materialise(rows, name))
        return self.tables[-1]

    def among(self, nodes: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
        """(a, b: links; at: dense spots) of nodes with roots."""
        found = self.written(search(nodes, words=self.words, distance=self.distance, similarity=self.similarity or 0.0, **how), "simhash-pairs")
        pairs = found.where(F.col("a").isNotNull()).select("a", "b").distinct()
        dense = found.where(F.col("at").isNotNull()).select("at").distinct()
        if self.similarity is None:
            return pairs, dense
        pairs = self.written(pairs, "simhash-candidates")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct()
        wanted = nodes.join(ends, F.col("node") == F.col("e"), "left_semi").select("node", "class")
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.written(wanted, "simhash-ends")
        if not wanted.isEmpty():
            more = self.written(shingle_sets(self.docs, wanted, self.shingle), "simhash-shingles")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            return pairs, dense  # no candidates
        return self.written(_similar(pairs, self.sets, self.similarity), "simhash-verified"), dense


def _linked(nodes: DataFrame, links: _Links) -> DataFrame:
    """node, component: the components of the nodes that have a link."""
    first, dense = links.among(nodes.withColumn("root", F.col("node")))
    if dense.isEmpty():
        return components(first)
    groups = links.written(components(first), "simhash-groups")
    of = groups.select(F.col("node").alias("g_node"), "component")
    rooted = nodes.join(of, F.col("node") == F.col("g_node"), "left").withColumn("root", F.coalesce("component", "node"))
    more, _ = links.among(links.written(rooted.drop("g_node", "component"), "simhash-rooted"), spots=dense, all_pairs=True)
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, words: int = 1, distance: int = DISTANCE, similarity: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, class (MD5 of its text), fp (its first 64 bits, long), component_id: the smallest doc_id
    reachable over links, itself included, component: a number of the group, which names one without ids too, and the columns
    named in `keep`.

    Args:
        docs: doc_id long, text string; other columns are ignored unless named in `keep`, whatever their names.
        words: 64-bit words of a fingerprint.
        distance: differing bits of linked fingerprints. Up to 5 with one word all links are found; beyond that, or with more
            words, those that share a one-wildcard variant, so a link is found the likelier the more words there are.
        similarity: if given, texts are linked only if this share of their different shingles (of both) is common to them.
    A null text counts as empty. Texts without words have fingerprint zero and link like any other; with `similarity` they
    link with each other. Repeated rows stay rows of their own in one component. A null doc_id takes part, and names a
    component only where there is no other. An empty table gives no rows.
    """
    if words == 1 and distance > 5 and similarity is None:
        raise ValueError("three segments with one wildcard find up to five differing bits")
    marked = fingerprints(docs, shingle, words, keep)
    marked = common.materialise(marked if similarity else marked.drop("parity"), "simhash")
    by = ["fp0"] if similarity is None and words == 1 else ["class"]
    prints = [F.first(c).alias(c) for c in ("n", *(f"fp{i}" for i in range(words)), "parity") if c not in by and (similarity or c != "parity")]
    classes = marked.groupBy(*by).agg(F.min("kept.doc_id").alias("least"), *prints)
    node = F.col("fp0") if by == ["fp0"] else F.monotonically_increasing_id()
    nodes = common.materialise(classes.withColumn("node", node), "simhash-nodes")
    links = _Links(docs, shingle, words, distance, similarity)
    linked = common.materialise(_linked(nodes, links), "simhash-components")
    for written in links.tables:
        common.forget(written)
    named = nodes.join(linked.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").withColumn("component", F.coalesce("component", "node"))
    of_group = named.where(F.col("l_node").isNotNull()).groupBy(F.col("component").alias("c")).agg(F.min("least").alias("group_least"))
    named = named.join(of_group, F.col("component") == F.col("c"), "left").withColumn("component_id", F.when(F.col("l_node").isNotNull(), F.col("group_least")).otherwise(F.col("least")))
    named = named.select(F.col(by[0]).alias("n_class"), "component", "component_id")
    return marked.join(named, F.col(by[0]) == F.col("n_class")).select("kept.doc_id", "class", F.col("fp0").alias("fp"), "component_id", "component", *(f"kept.{c}" for c in keep))
