"""Removal of repeated byte strings by sorted suffixes.

A byte of a document goes if it lies in a `length`-byte string that also starts in a document with a smaller doc_id.

0. Copies. A text that equals that of a smaller doc_id goes whole (if it has `length` bytes) and is not compared: what
   it holds, the first one holds too.
1. Anchors. Any two equal strings of `length` bytes hold the same `GRAM`-byte minimizers at the same places, so only
   minimizers (about a tenth of all positions) are compared first. Their hashes are dealt by value, and a hash that
   occurs in two documents or more marks its anchors.
2. Contexts. Every marked anchor sends the bytes round it that a string through it can reach to the shard of its hash.
   Equal contexts collapse to the smallest doc_id, in their chunk first, so a passage that a third of all documents
   hold costs one record a chunk.
3. Induced sorting. A shard's contexts are aligned at their right ends and their suffixes sorted from the shortest to
   the longest: the order of all suffixes that start at one place gives the order of those one byte further left by
   dealing them, in order, into queues by that byte. The queues are on disk beyond a memory bound; their tuples carry
   the context and its common prefix with the tuple before, which is induced too. Runs of tuples whose common prefix
   is `length` or more hold equal strings; all but those of the run's smallest document are repeats.
4. The repeats return to their documents as one bit per starting place, and are cut out.

Step 1 only leaves out what cannot repeat; hash collisions there cost time, not results, as step 3 compares bytes.

Scale: documents lie in compressed chunks in a bucketed table and do not move after that. Every shuffle holds one row per
(chunk, shard). A shard's memory is
bounded: beyond SHARD_RECORDS its records and bits are in files of the task's own temporary folder, and are judged hash
range by hash range (contexts of different hashes never meet); queues spill there too. A hash that alone has more is sorted
by one task, column by column. A document of any length sends a slice of its anchors at a time, equal contexts once.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 30
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 2 << 20
#: Tuples that a sort's queues keep in memory before they go to disk.
QUEUE_TUPLES = 4_000_000
#: Tuples that are dealt at a time.
BATCH = 1 << 16
#: Records of a shard that are judged at a time, and beyond which its records are kept in a file.
SHARD_RECORDS = 400_000
#: Anchors whose contexts are cut out at a time.
SLICE = 1 << 15
NONE = np.iinfo(np.int64).max  # a null doc_id comes last


# ---------------------------------------------------------------- anchors


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least over every window of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[: len(out) - step], out[step:])
        have += step
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 48-bit hash of every `gram` bytes: differences of a running polynomial, moved to one power, then mixed."""
    n = len(data)
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    up, down = _POWERS[size]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h & np.uint64((1 << 48) - 1)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are the least in some string of `length` bytes; equals all count."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    window = length - gram + 1
    low = _sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    reach = _sliding(np.concatenate((edge, low, edge)), window, np.maximum)
    at = np.flatnonzero(reach == h)
    return at, h[at]


class Chunk:
    """The documents of a chunk as one array of bytes; work goes document by document."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes, copies: list[int] | None = None):
        self.copies = frozenset(copies or ())  # numbers of documents that equal an earlier one: nothing is compared
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for doc, start, size in zip(self.ids.tolist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield doc, self.data[start : start + size]

    def anchored(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, position in the chunk, hash) of all anchors, by document, then position."""
        at, hashes = [], []
        for number, ((_, data), start) in enumerate(zip(self, self.starts.tolist(), strict=True)):
            p, h = anchors(data[:0] if number in self.copies else data, length, gram)
            at.append(p + start)
            hashes.append(h)
        position = np.concatenate(at) if at else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(at)), [len(p) for p in at])
        return number, position, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def _packed(hashes: np.ndarray) -> bytes:
    """Six bytes a hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.concatenate((six, np.zeros((len(six), 2), np.uint8)), axis=1).view("<u8").ravel()


def _by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, indices) of the shards that occur, indices ascending."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]


# ---------------------------------------------------------------- induced sorting


class Queues:
    """One first-in-first-out queue a byte value, read by ascending byte: a radix priority queue that spills to disk."""

    TUPLE = np.dtype([("context", "<i4"), ("prefix", "<i4")])

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.parts: list[list] = [[] for _ in range(257)]
        self.file = None

    def push(self, value: int, tuples: np.ndarray) -> None:
        self.parts[value].append(tuples)
        self.held += len(tuples)
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for parts in self.parts:
                for i, p in enumerate(parts):
                    if isinstance(p, np.ndarray):
                        parts[i] = (self.file.seek(0, 2), len(p))
                        self.file.write(p.tobytes())
            self.held = 0

    def read(self) -> Iterator[np.ndarray]:
        """All tuples by value, then arrival, in batches."""
        batch, size = [], 0
        for parts in self.parts:
            for p in parts:
                if not isinstance(p, np.ndarray):
                    self.file.seek(p[0])
                    p = np.frombuffer(self.file.read(p[1] * self.TUPLE.itemsize), self.TUPLE)
                batch.append(p)
                size += len(p)
                if size >= BATCH:
                    yield np.concatenate(batch)
                    batch, size = [], 0
        if batch:
            yield np.concatenate(batch)
        if self.file:
            self.file.close()


class RangeLeast:
    """Least value of any range of an array, from tables of doubling ranges."""

    def __init__(self, values: np.ndarray):
        self.tables, width = [values], 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each pair, the least of values[low : high]; low < high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.tables[k][low[at]], self.tables[k][high[at] - (1 << k)])
        return out


class Contexts:
    """Contexts as values 1 to 256, and 0 outside the text [low, high), made column by column from their bytes."""

    def __init__(self, data: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.columns, self.low, self.high = np.ascontiguousarray(data.T), low, high
        self.shape = data.shape

    def __len__(self) -> int:
        return self.shape[0]

    def column(self, at: int) -> np.ndarray:
        return np.where((at >= self.low) & (at < self.high), self.columns[at].astype(np.int16) + 1, 0).astype(np.int16)

    @classmethod
    def of(cls, values: np.ndarray) -> Contexts:
        """From an m x width array of values, 0 at the ends only."""
        inside = values != 0
        low = np.where(inside.any(axis=1), inside.argmax(axis=1), 0)
        return cls((values - 1).astype(np.uint8), low, low + inside.sum(axis=1))


def sorted_suffixes(contexts: Contexts, last: int, limit: int = QUEUE_TUPLES) -> Iterator[tuple[int, _Tee]]:
    """(start, tuples) for start = last, last - 1, ... 0: the suffixes from `start` of all contexts, in order, with their common prefixes with the one before. The caller must read all of a start's tuples."""
    m, width = contexts.shape
    first = np.zeros(m, Queues.TUPLE)
    first["context"] = np.arange(m)
    source: Iterator[np.ndarray] = iter([first])
    for start in range(width - 1, -1, -1):
        queues = Queues(limit)
        # Least common prefix since the last tuple of a queue; -1: it has none yet.
        since = np.full(257, -1, np.int64)
        column = contexts.column(start)
        for whole in source:
            for at in range(0, len(whole), BATCH):
                _deal(whole[at : at + BATCH], column, queues, since)
        if start <= last:
            tee = _Tee(queues, limit)
            yield start, tee
            source = tee.again.read()
        else:
            source = queues.read()


def _deal(part: np.ndarray, column: np.ndarray, queues: Queues, since: np.ndarray) -> None:
    """Push a batch of tuples, in order, to the queues of the values one place further left. The common prefix with the
    tuple before in the same queue is one more than the least since that tuple."""
    values = column[part["context"]]
    prefix = part["prefix"].astype(np.int64)
    order = np.argsort(values, kind="stable")
    sorted_ = values[order]
    heads = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1))
    before = np.concatenate(([-1], order[:-1]))
    before[heads] = -1
    least = RangeLeast(prefix)
    low = least(before + 1, order + 1)
    seen = sorted_[heads].astype(np.int64)
    low[heads] = np.where(since[seen] < 0, -1, np.minimum(low[heads], since[seen]))
    out = np.empty(len(order), Queues.TUPLE)
    out["context"], out["prefix"] = part["context"][order], low + 1
    for value, own in zip(seen.tolist(), np.split(out, heads[1:]), strict=True):
        queues.push(value, own)
    ends = order[np.concatenate((heads[1:], [len(order)])) - 1] + 1
    rest = np.full(len(seen), np.iinfo(np.int64).max)
    open_ = ends < len(prefix)
    rest[open_] = least(ends[open_], np.full(int(open_.sum()), len(prefix)))
    known = since >= 0
    since[known] = np.minimum(since[known], prefix.min())
    since[seen] = rest


class _Tee:
    """The tuples of a start, kept while they are read, so the next start can be induced from them."""

    def __init__(self, queues: Queues, limit: int):
        self.queues, self.again = queues, Queues(limit)

    def read(self) -> Iterator[np.ndarray]:
        for batch in self.queues.read():
            self.again.push(0, batch)
            yield batch


def repeats(contexts: Contexts, documents: np.ndarray, length: int, limit: int = QUEUE_TUPLES) -> np.ndarray:
    """For each context a number with a bit for each place up to width - length (bit 0: the first): whether the `length` bytes
    from that place also start, at the same place, in a context of a smaller document. What is outside of a text matches
    nothing."""
    places = contexts.shape[1] - length + 1
    out = np.zeros(len(contexts), np.uint64)
    if not len(contexts):
        return out
    for start, queues in sorted_suffixes(contexts, places - 1, limit):
        whole = (contexts.low <= start) & (start + length <= contexts.high)
        open_ = np.zeros(0, np.int64)

        def close(number: np.ndarray, rows: np.ndarray, start=start, whole=whole) -> None:
            """Judge finished runs: their contexts in order, with the numbers of their runs."""
            docs = documents[rows]
            cuts = np.flatnonzero(np.diff(number)) + 1
            low = np.minimum.reduceat(docs, np.concatenate(([0], cuts)))
            low = np.repeat(low, np.diff(np.concatenate(([0], cuts, [len(rows)]))))
            out[rows] |= (whole[rows] & (docs > low)).astype(np.uint64) << np.uint64(start)

        for part in queues.read():
            rows = part["context"].astype(np.int64)
            begins = part["prefix"] < length
            if not begins.any():
                open_ = np.concatenate((open_, rows))
                continue
            end = len(rows) - 1 - int(np.argmax(begins[::-1]))
            done = np.concatenate((open_, rows[:end]))
            if len(done):
                marks = np.concatenate((np.zeros(len(open_), bool), begins[:end]))
                close(np.cumsum(marks), done)
            open_ = rows[end:]
        if len(open_):
            close(np.zeros(len(open_), np.int64), open_)
    return out


# ---------------------------------------------------------------- the operator


def _records(width: int) -> np.dtype:
    return np.dtype([("hash", "<u8"), ("doc", "<i8"), ("bytes", "u1", (width,)), ("inside", "<u2")])


def _context_records(chunk: Chunk, number: np.ndarray, position: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The bytes from length - gram before each anchor to length - gram after it; `inside` packs how many of either side exist."""
    side = length - gram
    out = np.zeros(len(position), _records(gram + 2 * side))
    start, end = chunk.starts[number], chunk.starts[number] + chunk.sizes[number]
    left, right = np.minimum(side, position - start), np.minimum(side, end - position - gram)
    padded = np.concatenate((np.zeros(side, np.uint8), chunk.data, np.zeros(side + gram, np.uint8)))
    rows = padded[position[:, None] + np.arange(gram + 2 * side)[None, :]]
    at = np.arange(gram + 2 * side)[None, :]
    rows[(at < (side - left)[:, None]) | (at >= (side + gram + right)[:, None])] = 0
    out["hash"], out["doc"], out["bytes"], out["inside"] = hashes, chunk.ids[number], rows, left * 256 + right
    return out


def _collapsed(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, group): one record of the smallest document for each different context, by hash; and each record's place in it."""
    wide = lambda c, n: np.ascontiguousarray(records[c]).view(np.uint8).reshape(len(records), n)
    plain = np.concatenate((wide("hash", 8), records["bytes"], wide("inside", 2)), axis=1)
    keys = plain.view(np.dtype((np.void, plain.shape[1]))).ravel()
    order = _order(keys, records["doc"])
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _distinct(chunk: Chunk, number: np.ndarray, position: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(records, group): the different contexts of these anchors, each with its smallest document, and each anchor's place
    among them. Anchors are taken a slice at a time, so a long run of equal bytes, all of which are anchors, costs one record."""
    parts, groups, had = [np.zeros(0, _records(2 * length - gram))], [], 0
    for at in range(0, len(position), SLICE):
        cut = slice(at, at + SLICE)
        records = _context_records(chunk, number[cut], position[cut], hashes[cut], length, gram)
        heads, group = _collapsed(records)
        parts.append(records[heads])
        groups.append(group + had)
        had += len(heads)
    records = np.concatenate(parts)
    heads, group = _collapsed(records)
    return records[heads], group[np.concatenate(groups)] if groups else np.zeros(0, np.int64)


def _every(records: np.ndarray, side: int) -> np.ndarray:
    """For each record, the bits of all starting places of strings that lie in its text."""
    left, right = (records["inside"] >> 8).astype(np.int64), (records["inside"] & 255).astype(np.int64)
    out = np.zeros(len(records), np.uint64)
    for place in range(side + 1):
        out |= ((place >= side - left) & (place <= right)).astype(np.uint64) << np.uint64(place)
    return out


def _shard_repeats(records: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each record, a bit for each starting place of a repeated string round its anchor (bit 0: the leftmost)."""
    side = length - gram
    heads, group = _collapsed(records)
    first = records[heads]
    hashes = first["hash"]
    # Contexts that are alone under their hash share strings with copies of themselves only.
    again = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(heads) else np.zeros(0, bool)
    shared = np.flatnonzero(again | np.concatenate((again[1:], [False]))) if len(heads) else np.zeros(0, np.int64)
    own = np.zeros(len(heads), np.uint64)
    if len(shared):
        left, right = (first["inside"][shared] >> 8).astype(np.int64), (first["inside"][shared] & 255).astype(np.int64)
        contexts = Contexts(first["bytes"][shared], side - left, side + gram + right)
        own[shared] = repeats(contexts, first["doc"][shared], length)
    return np.where(records["doc"] > first["doc"][group], _every(first, side)[group], own[group])


class Spool:
    """Records in the order in which they came: in memory, or in a file once there are more than `limit`."""

    def __init__(self, kind: np.dtype, limit: int):
        self.kind, self.limit, self.count = kind, limit, 0
        self.parts: list[np.ndarray] = []
        self.file = None

    def add(self, records: np.ndarray) -> None:
        self.count += len(records)
        self.parts.append(records)
        if self.count > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts = []

    def all(self) -> np.ndarray:
        if not self.file:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.count,))


def _judged_ranges(records: np.ndarray, length: int, gram: int, limit: int) -> np.ndarray:
    """The bits of `_shard_repeats`, judged a range of hashes at a time; in a file if there are more records than `limit`."""
    if len(records) <= limit:
        return _shard_repeats(records, length, gram)
    ranges = -(-2 * len(records) // limit)
    out = np.memmap(tempfile.TemporaryFile(), "<u8", "w+", shape=(len(records),))
    part = np.empty(len(records), np.int32)
    for at in range(0, len(records), limit):
        # The low bits: the shard's number comes from the others.
        part[at : at + limit] = (records["hash"][at : at + limit] & np.uint64((1 << 20) - 1)) % np.uint64(ranges)
    for own in range(ranges):
        rows = np.flatnonzero(part == own)
        out[rows] = _shard_repeats(np.asarray(records[rows]), length, gram)
    return out


def _order(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    by_doc = np.argsort(docs, kind="stable")
    return by_doc[np.argsort(keys[by_doc], kind="stable")]


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of struct(start, end)); with
    `keep_bytes` also `kept`, the remaining bytes.

    Args:
        docs: doc_id long, text string; other columns are ignored, whatever their names.
        length: of the strings, in UTF-8 bytes; `gram`: of the anchors, at least 8, and less than `length` by 1 to 63.
    A null text counts as empty. Strings are judged on the input, never across documents; a string that repeats in one
    document only stays, and rows that share a doc_id are not before one another. A null doc_id comes after all others.
    An empty table gives no rows.
    """
    if not 8 <= gram < length <= gram + 63:
        raise ValueError("gram must be at least 8 and 1 to 63 bytes shorter than length")
    spark = docs.sparkSession
    shards = common.shuffle_partitions(spark)
    side = length - gram
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), common.text_or_empty().cast("binary").alias("text"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, ids, nulls, texts, size = context.partitionId() << 32, [], [], [], 0

        def given() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], "<i8")
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            columns = [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(ids, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), sizes.tobytes(), blob))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "nulls", "sizes", "blob"])

        for batch in common.lean(batches):
            for i, none, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "no_id", "text")), strict=True):
                ids.append(i)
                nulls.append(none)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield given()
                    number, ids, nulls, texts, size = number + 1, [], [], [], 0
        if ids:
            yield given()

    # A bucketed table: what comes back to chunks is joined to them where they lie, without moving text again.
    name = f"repeats_chunks_{uuid.uuid4().hex}"
    plain.mapInArrow(chunked, "chunk long, ids binary, nulls binary, sizes binary, blob binary").write.format("parquet").bucketBy(shards, "chunk").option("path", f"{common.shared_dir(spark)}/{name}").saveAsTable(name)
    whole = spark.table(name)

    def opened(batch: pa.RecordBatch, i: int) -> Chunk:
        return Chunk(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "blob", "copies")))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.lean(batches):
            for i in range(batch.num_rows):
                chunk = Chunk(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "blob")))
                digests = [xxhash.xxh3_128_digest(data.tobytes()) for _, data in chunk]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[i].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(chunk.ids), pa.array(digests, pa.binary())], names=["c_chunk", "number", "doc", "digest"])

    texts = common.materialise(whole.select("chunk", "ids", "sizes", "blob").mapInArrow(digested, "c_chunk long, number int, doc long, digest binary"), "repeats-texts")
    firsts = texts.groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = texts.join(firsts, F.col("digest") == F.col("f_digest")).where(F.col("doc") > F.col("first")).groupBy("c_chunk").agg(F.collect_list("number").alias("copies"))
    chunks = whole.join(common.materialise(copies, "repeats-copies"), F.col("chunk") == F.col("c_chunk"), "left").drop("c_chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.lean(batches):
            for i in range(batch.num_rows):
                number, _, hashes = opened(batch, i).anchored(length, gram)
                # Once a document, and twice a chunk at most: a hash that occurs twice then occurs in two documents.
                order = np.lexsort((number, hashes))
                n, h = number[order], hashes[order]
                h = h[np.concatenate(([True], (n[1:] != n[:-1]) | (h[1:] != h[:-1])))] if len(h) else h
                h = h[np.concatenate((np.ones(min(2, len(h)), bool), h[2:] != h[:-2]))]
                rows = [(s, h[at]) for s, at in _by_shard(_shard(h, shards), shards)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[i].as_py()] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int32()), pa.array([_packed(x) for _, x in rows], pa.binary())], names=["chunk", "shard", "hashes"])

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk, its hashes in this shard that occur in two documents or more."""
        chunk_of, shard_of, sets = [], [], []
        for batch in common.lean(batches):
            chunk_of += batch.column("chunk").to_pylist()
            shard_of += batch.column("shard").to_pylist()
            sets += [_unpacked(x) for x in batch.column("hashes").to_pylist()]
        if not sets:
            return
        every = np.sort(np.concatenate(sets))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        for c, s, own in zip(chunk_of, shard_of, sets, strict=True):
            own = np.unique(own)
            at = np.searchsorted(twice, own)
            hit = own[twice[np.minimum(at, len(twice) - 1)] == own] if len(twice) else own[:0]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([s], pa.int32()), pa.array([_packed(hit)], pa.binary())], names=["chunk", "shard", "hashes"])

    keys = chunks.mapInArrow(hashed, "chunk long, shard int, hashes binary").repartitionById(shards, F.col("shard"))
    marks = keys.mapInArrow(flagged, "chunk long, shard int, hashes binary").groupBy(F.col("chunk").alias("m_chunk")).agg(F.collect_list("hashes").alias("marked"))
    marks = common.materialise(marks, "repeats-marked")

    def chosen(batch: pa.RecordBatch, i: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
        """A chunk's anchors whose hashes are marked, in a fixed order."""
        chunk = opened(batch, i)
        number, position, hashes = chunk.anchored(length, gram)
        marked = np.sort(np.concatenate([_unpacked(x) for x in batch.column("marked")[i].as_py() or []] or [np.zeros(0, "<u8")]))
        if not len(marked):
            return chunk, number[:0], position[:0], hashes[:0]
        hit = marked[np.minimum(np.searchsorted(marked, hashes), len(marked) - 1)] == hashes
        return chunk, number[hit], position[hit], hashes[hit]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in common.lean(batches):
            for i in range(batch.num_rows):
                chunk, number, position, hashes = chosen(batch, i)
                for s, at in _by_shard(_shard(hashes, shards), shards):
                    records, _ = _distinct(chunk, number[at], position[at], hashes[at], length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[i].as_py()], pa.int64()), pa.array([s], pa.int32()), pa.array([press.compress(records.tobytes())], pa.binary())], names=["chunk", "shard", "records"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, chunk_of, shard_of, sizes = zstandard.ZstdDecompressor(), [], [], []
        spool = Spool(_records(gram + 2 * side), SHARD_RECORDS)
        for batch in common.lean(batches):
            chunk_of += batch.column("chunk").to_pylist()
            shard_of += batch.column("shard").to_pylist()
            for x in batch.column("records"):
                part = np.frombuffer(open_.decompress(x.as_py()), spool.kind)
                spool.add(part)
                sizes.append(len(part))
        if not spool.count:
            return
        masks = _judged_ranges(spool.all(), length, gram, SHARD_RECORDS)
        for c, s, own in zip(chunk_of, shard_of, np.split(masks, np.cumsum(sizes)[:-1]), strict=True):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([s], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(own.astype("<u8").tobytes())], pa.binary())], names=["chunk", "shard", "masks"])

    both = chunks.join(marks, F.col("chunk") == F.col("m_chunk"))
    contexts = both.select("chunk", "ids", "sizes", "blob", "copies", "marked").mapInArrow(sent, "chunk long, shard int, records binary").repartitionById(shards, F.col("shard"))
    judgements = contexts.mapInArrow(judged, "chunk long, shard int, masks binary").groupBy(F.col("chunk").alias("j_chunk")).agg(F.collect_list(F.struct("shard", "masks")).alias("judged"))
    judgements = common.materialise(judgements, "repeats-judged")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.lean(batches):
            for i in range(batch.num_rows):
                judged_ = batch.column("judged")[i].as_py() or []
                if judged_:
                    chunk, number, position, hashes = chosen(batch, i)
                    parts = dict(_by_shard(_shard(hashes, shards), shards))
                    edge = np.zeros(len(chunk.data) + 1, np.int32)
                    for found in judged_:
                        at = parts[found["shard"]]
                        records, group = _distinct(chunk, number[at], position[at], hashes[at], length, gram)
                        _cover(edge, records, group, chunk.ids[number[at]], position[at], np.frombuffer(zstandard.ZstdDecompressor().decompress(found["masks"]), "<u8"), side, length)
                    covered = np.cumsum(edge[:-1]) > 0
                else:
                    chunk = opened(batch, i)
                    covered = np.zeros(len(chunk.data), bool)
                rows = []
                nulls = np.frombuffer(batch.column("nulls")[i].as_py(), np.uint8)
                for n, ((doc, data), none, start) in enumerate(zip(chunk, nulls.tolist(), chunk.starts.tolist(), strict=True)):
                    gone = np.full(len(data), len(data) >= length) if n in chunk.copies else covered[start : start + len(data)]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    kept = data[~gone].tobytes()
                    rows.append((None if none else doc, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()], kept if keep_bytes else None))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    last = chunks.join(marks, F.col("chunk") == F.col("m_chunk"), "left").join(judgements, F.col("chunk") == F.col("j_chunk"), "left")
    out = last.select("ids", "nulls", "sizes", "blob", "copies", "marked", "judged").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
    # The plan holds the table's files; the name is not needed any more, and dropping it leaves them.
    spark.sql(f"DROP TABLE {name}")
    return out if keep_bytes else out.drop("kept")


def _cover(edge: np.ndarray, records: np.ndarray, group: np.ndarray, docs: np.ndarray, position: np.ndarray, masks: np.ndarray, side: int, length: int) -> None:
    """Count the repeated strings round a shard's anchors in a chunk: +1 in `edge` where one starts, -1 after its end.
    `masks` belongs to the chunk's different contexts; in the later documents that hold one, all of it repeats."""
    own = np.where(docs > records["doc"][group], _every(records, side)[group], masks[group])
    for place in range(side + 1):
        hit = position[(own >> np.uint64(place)) & np.uint64(1) == 1] - side + place
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
