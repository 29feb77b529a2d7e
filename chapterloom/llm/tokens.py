"""Exact byte-level BPE ids of batches of texts, word by word through a per-process memory.

The byte-level pre-tokenizer never lets a piece run from a non-space character into white space, so a text may be cut
before every blank that follows a non-space character, and the parts encoded on their own. A batch is cut and its words
numbered by Arrow; only its different words are looked up, those that are new are encoded by the `tokenizers` library,
many in one text, and cut apart again by the byte lengths of their tokens. The ids of all texts are then one gathered
array. A text is encoded whole if that cut is not safe (white space stands before a blank), or if it holds the string of
a token that the file adds to the vocabulary.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Words in a Python worker's memory; beyond it those seldom met are let go. This is a bound on memory only: results do
#: not depend on it.
CACHE_WORDS = 500_000
#: Bytes of text and number of texts that are encoded at a time.
SLICE_BYTES, SLICE_TEXTS = 3 << 20, 2048
#: New words that the library gets in one text.
TOGETHER = 100
WHOLE, NEW = -1, -2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> str:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in own else next(other)) for b in range(256))


@dataclass
class Encoded:
    """All ids of a batch, text after text, and how many each text has."""

    ids: np.ndarray
    counts: np.ndarray


class BatchEncoder:
    """encode(texts) gives the ids that the library gives for each whole text, without special tokens put round it.

    special_as_text: whether the string of a special token in a text is ordinary text; by default it is that token, as
    the file says.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Bytes of text that each token stands for.
        self.width = np.zeros(size, np.int32)
        for token, i in vocabulary.items():
            self.width[i] = len(token.encode()) if token in added else len(token)
        self.added = [] if special_as_text else list(added)
        self._reset({}, np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _reset(self, known: dict[str, int], pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.known = known  # word after a blank -> its number
        self.pool, self.used = pool, len(pool)
        self.starts, self.lengths = starts, lengths
        self.uses = np.zeros(len(starts), np.int32)

    def _forget(self) -> None:
        """Keep the words met in most batches, half of the memory at most."""
        names, at = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        uses = self.uses[at]
        best = np.argsort(-uses, kind="stable")[: CACHE_WORDS // 2]
        best = best[uses[best] > 1]
        lengths = self.lengths[at[best]]
        starts = np.cumsum(lengths) - lengths
        self._reset({names[i]: n for n, i in enumerate(best.tolist())}, self.pool[_ranges(self.starts[at[best]], lengths)], starts, lengths)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Put values into the memory; the number of the first."""
        first = len(self.starts)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(ids), self.used, 1 << 16), self.dtype)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.uses = np.concatenate((self.uses, np.zeros(len(lengths), np.int32)))
        self.used += len(ids)
        return first

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each different word as it is after a blank; WHOLE: a text that holds it is not cut."""
        known = self.known
        names = words.to_pylist()
        out = np.fromiter((known.get(w, NEW) for w in names), np.int64, len(names))
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        # An empty word stands between two blanks.
        ends_blank = (sizes == 0) | (sizes != pc.binary_length(pc.utf8_rtrim_whitespace(words)).to_numpy(zero_copy_only=False))
        new = np.flatnonzero((out == NEW) & ~ends_blank)
        if len(new):
            plain = [names[i] for i in new.tolist()]
            ids = np.concatenate(self._library([" " + " ".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]))
            ends = np.cumsum(self.width[ids], dtype=np.int64)
            wanted = np.cumsum(sizes[new] + 1)
            last = np.searchsorted(ends, wanted)
            if last[-1] != len(ends) - 1 or not np.array_equal(ends[last], wanted):
                raise ValueError("the tokenizer file is not a byte-level one that splits words at blanks")
            first = self._add(ids, np.diff(last + 1, prepend=0).astype(np.int64))
            out[new] = np.arange(first, first + len(plain))
            known.update(zip(plain, range(first, first + len(plain)), strict=True))
        out[ends_blank] = WHOLE
        self.uses[out[~ends_blank]] += 1
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> Encoded:
        """The ids of each text (no nulls), with the id `end` after them if it is given."""
        n = len(texts)
        if not n:
            return Encoded(np.zeros(0, self.dtype), np.zeros(0, np.int64))
        if len(self.known) > CACHE_WORDS:
            self._forget()
        whole = np.zeros(n, bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        words = cut.flatten().dictionary_encode()
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(sizes) - sizes
        codes = words.indices.to_numpy(zero_copy_only=False)
        numbers = self._numbers(words.dictionary)
        slots = numbers[codes]
        # The first word of a text has no blank before it: these, and texts that are not cut, get values of this batch only.
        open_ = (slots[heads] != WHOLE) | (sizes == 1) | (pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)[codes[heads]] == 0)
        slots[heads] = 0
        whole |= (np.minimum.reduceat(slots, heads) == WHOLE) | ~open_
        starting = words.dictionary.take(pa.array(codes[heads])).to_pylist()
        for i in np.flatnonzero(whole).tolist():
            starting[i] = texts[i].as_py()
        different = list(dict.fromkeys(starting))
        own = self._library(different)
        place = {t: i for i, t in enumerate(different)}
        more = np.concatenate([*own, np.zeros(0, self.dtype) if end is None else np.array([end], self.dtype)])
        more_lengths = np.array([len(x) for x in own] + ([] if end is None else [1]), np.int64)
        starts = np.concatenate((self.starts, self.used + np.cumsum(more_lengths) - more_lengths))
        lengths = np.concatenate((self.lengths, more_lengths))
        pool = np.concatenate((self.pool[: self.used], more))
        slots[heads] = len(self.starts) + np.array([place[t] for t in starting], np.int64)
        if whole.any():
            at_head = np.zeros(len(slots), bool)
            at_head[heads] = True
            kept = ~np.repeat(whole, sizes) | at_head
            sizes = np.where(whole, 1, sizes)
            slots = slots[kept]
        if end is not None:
            slots = np.insert(slots, np.cumsum(sizes), len(starts) - 1)
            sizes = sizes + 1
        held = lengths[slots]
        ends = np.concatenate(([0], np.cumsum(held)))[np.cumsum(sizes)]
        return Encoded(pool[_ranges(starts[slots], held)], np.diff(ends, prepend=0))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    small = np.int32 if len(starts) == 0 or int(lengths.sum()) + int(starts.max(initial=0)) < 1 << 31 else np.int64
    before = np.cumsum(lengths) - lengths
    out = np.repeat((starts - before).astype(small), lengths)
    out += np.arange(len(out), dtype=small)
    return out


def slices(batch: pa.RecordBatch, column: str = "text") -> list[pa.RecordBatch]:
    """The batch in parts of few texts and bytes (a long text is a part of its own)."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, min(at + SLICE_TEXTS, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right"))))
        out.append(batch.slice(at, to - at))
        at = to
    return out


def encoder(path: str, special_as_text: bool = False) -> BatchEncoder:
    """The process's encoder for `path`; Python workers are reused, so its memory serves many tasks."""
    return common.held(("encoder", path, special_as_text), lambda: BatchEncoder(path, special_as_text))
