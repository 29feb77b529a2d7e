"""Packing along a space-filling curve.

Every document becomes a hashed bag-of-tokens vector, is projected to a few dimensions, gets a Hilbert key there, and
the documents are range-partitioned and sorted by that key. Each partition is then one stream along the curve that is
cut into sequences of `length` tokens, so neighbours on the curve share sequences.

Scale: ids are made once and cross one shuffle. Range bounds come from a sample of keys whose size depends only on the
number of partitions. Documents with equal keys (copies) are spread by a hash of their id, which is part of the key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

DIMS = 4
BITS = 8
HASHED = 1024
SAMPLE_PER_PARTITION = 40
#: Documents whose vectors are held at a time.
DENSE = 512


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS)).astype(np.float32)


def coordinates(encoded: tokens.Encoded, project: np.ndarray) -> np.ndarray:
    """The projected hashed term-frequency vector of each document; one without ids lies at the origin."""
    n = len(encoded.counts)
    out = np.zeros((n, DIMS), np.float32)
    ends = np.cumsum(encoded.counts)
    for at in range(0, n, DENSE):
        counts = encoded.counts[at : at + DENSE]
        ids = encoded.ids[ends[at] - counts[0] : ends[at + len(counts) - 1]]
        bins = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - HASHED.bit_length() + 1)
        bins = bins.astype(np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32) * HASHED, counts)
        held = np.sqrt(np.bincount(bins, minlength=len(counts) * HASHED).astype(np.float32)).reshape(-1, HASHED)
        length = np.sqrt(counts.astype(np.float32))  # the squares of the roots add up to the number of ids
        out[at : at + DENSE] = (held @ project) / np.maximum(length, 1)[:, None]
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n x dims), each coordinate below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(coords: np.ndarray, spread: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sort key: the Hilbert key of coordinates cut at `edges`, then 31 bits that spread equal documents."""
    cells = np.stack([np.searchsorted(edges[d], coords[:, d], side="right") for d in range(DIMS)], axis=1)
    return (hilbert(cells) << 31) | (spread & 0x7FFFFFFF)


def _binary(encoded: tokens.Encoded) -> pa.Array:
    """The ids of each document as bytes."""
    ends = np.concatenate(([0], np.cumsum(encoded.counts))) * encoded.ids.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(encoded.counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(encoded.ids))])


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str | None = None,
    special_as_text: bool = False,
    length: int = 2048,
    eos: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Args:
        docs: doc_id long, text string; other columns are ignored, whatever their names.
        tokenizer_path: file for the `tokenizers` library; `eos` follows every document's ids.
        special_as_text: whether a special token's string in a text is ordinary text and not that token.
    A null text counts as empty and still yields its end token; a null doc_id is kept as null. Repeated rows are packed
    once each. Only the last sequence of a partition can be short; it is cut at powers of two, which need no padding.
    An empty table gives no pieces.
    """
    spark = docs.sparkSession
    common.text_batches(spark)
    path = tokenizer_path or tokens.default_path()
    parts = partitions or common.shuffle_partitions(spark)
    project = projection()
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.text_or_empty().alias("text"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("spread"),
    )

    def sampled(batches):
        for whole in common.lean(batches):
            for batch in tokens.slices(whole):
                coords = coordinates(tokens.encoder(path, special_as_text).encode(batch.column("text"), eos), project)
                out = [pa.array(coords[:, d]) for d in range(DIMS)] + [batch.column("spread")]
                yield pa.RecordBatch.from_arrays(out, names=[*(f"c{d}" for d in range(DIMS)), "spread"])

    total = docs.count()
    wanted = max(1000, SAMPLE_PER_PARTITION * parts)
    # About `wanted` rows, encoded where they lie: their number is set by the partitions, not by the input.
    sample = plain.sample(fraction=min(1.0, 1.2 * wanted / max(1, total)), seed=11)
    seen = sample.mapInArrow(sampled, ", ".join(f"c{d} float" for d in range(DIMS)) + ", spread long").toPandas()
    points = seen[[f"c{d}" for d in range(DIMS)]].to_numpy(np.float32)
    at = np.linspace(0, 1, (1 << BITS) + 1)[1:-1]
    edges = np.quantile(points, at, axis=0).T.astype(np.float32) if len(points) else np.zeros((DIMS, len(at)), np.float32)
    keys = np.sort(curve_key(points, seen["spread"].to_numpy(np.int64), edges)) if len(points) else np.zeros(0, np.int64)
    bounds = keys[(np.arange(1, parts) * len(keys)) // parts] if len(keys) else np.zeros(0, np.int64)

    def placed(batches):
        for whole in common.lean(batches):
            for batch in tokens.slices(whole):
                encoded = tokens.encoder(path, special_as_text).encode(batch.column("text"), eos)
                key = curve_key(coordinates(encoded, project), batch.column("spread").to_numpy(zero_copy_only=False), edges)
                part = np.searchsorted(bounds, key, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary(encoded), pa.array(key), pa.array(part)], names=["doc_id", "ids", "key", "part"])

    wide = tokens.encoder(path, special_as_text).dtype
    along = plain.mapInArrow(placed, "doc_id long, ids binary, key long, part int").repartitionById(parts, F.col("part")).sortWithinPartitions("key", "doc_id", "ids")

    def packed(batches):
        yield from _pack_stream(batches, length, wide)

    return along.mapInArrow(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _pack_stream(batches, length: int, wide: np.dtype) -> Iterator[pa.RecordBatch]:
    """Cut one partition's stream of documents into sequences; the last one is held back until its size is known."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64()] * 7
    full, filled, base = 0, 0, None
    tail: list[tuple] = []  # pieces of the open sequence, with their ids

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*pieces, strict=True), types, strict=True)], names=names)

    for whole in common.lean(batches):
        for batch in _slices(whole):
            out = []
            base = batch.column("part")[0].as_py() << 40 if base is None else base
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, wide).astype("<u4")
                at, n = 0, len(ids)
                while at < n:
                    take = min(length - filled, n - at)
                    tail.append((doc, at, ids[at : at + take], n, filled))
                    at += take
                    filled += take
                    if filled == length:
                        out += [(d, s, len(x), zlib.crc32(x.tobytes()), m, base + full, o) for d, s, x, m, o in tail]
                        tail, filled, full = [], 0, full + 1
            if out:
                yield rows(out)
    if tail:
        yield rows(_at_powers_of_two(tail, filled, base + full))


def _at_powers_of_two(tail: list[tuple], filled: int, sequence: int) -> list[tuple]:
    """The open sequence's pieces, cut again so that its parts are as long as the powers of two in `filled`."""
    cuts, at = [], 0
    for bit in range(filled.bit_length() - 1, -1, -1):
        if filled >> bit & 1:
            cuts.append((at, at + (1 << bit)))
            at += 1 << bit
    out = []
    for k, (low, high) in enumerate(cuts):
        for doc, start, ids, n, offset in tail:
            a, b = max(low, offset), min(high, offset + len(ids))
            if a < b:
                piece = ids[a - offset : b - offset]
                out.append((doc, start + a - offset, len(piece), zlib.crc32(piece.tobytes()), n, sequence + k, a - low))
    return out
