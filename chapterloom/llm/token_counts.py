"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded whole and once. The character spans of its tokens are joined to the spans of its sections, and a
token that crosses a boundary is given to one section by a stated rule, so the counts of a document's sections add up
to the document's tokens. Encoding sections on their own would count pieces that the whole text does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

RULES = ("majority", "first", "last")


def line_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in `data` (texts in UTF-8, one after the other, ending at `ends`) where a line starts that is not its
    text's first; a line holds the line break that ends it."""
    out = np.flatnonzero(data == 10) + 1
    return out[~np.isin(out, ends)]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str, section_of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, over the texts of a batch.

    first / last: the section of the token's first / last character. majority: the section that holds most of its
    characters, of equals the first.

    Args:
        starts, ends: the tokens' first byte and the byte after their last.
        sections: the characters at which sections start, ascending, and the number of all characters.
        section_of, place: of every byte, the number of its section (empty ones hold none) and of its character.
    """
    low, high = section_of[starts], section_of[ends - 1]
    crossing = np.flatnonzero(low != high)
    chosen = high if rule == "last" else low
    if rule == "majority" and len(crossing):
        chosen = low.copy()
        first, last, a, b = low[crossing], high[crossing], place[starts[crossing]], place[ends[crossing] - 1] + 1
        most = np.minimum(sections[first + 1], b) - a
        at, step = np.arange(len(crossing)), 1
        while len(at):
            at = at[first[at] + step <= last[at]]
            here = first[at] + step
            held = np.minimum(sections[here + 1], b[at]) - sections[here]
            better = held > most[at]
            most[at[better]] = held[better]
            chosen[crossing[at[better]]] = here[better]
            step += 1
    n = len(sections) - 1
    return np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n)


def _given(bounds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, start in the text) of all sections from the arrays of a batch, 0 in front, each start once."""
    text, start = [np.arange(len(bounds))], [np.zeros(len(bounds), np.int64)]
    for i, own in enumerate(bounds.to_pylist()):
        cuts = np.unique(np.array([x for x in own or [] if x is not None and x > 0], np.int64))
        text.append(np.full(len(cuts), i))
        start.append(cuts)
    text, start = np.concatenate(text), np.concatenate(start)
    order = np.lexsort((start, text))
    return text[order], start[order]


def _lines(data: np.ndarray, place: np.ndarray, ends: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start in the text) of all lines of a batch."""
    at = line_starts(data, ends)
    text = np.searchsorted(ends, at, side="right")
    own = place[at] - (np.cumsum(chars) - chars)[text]
    text, start = np.concatenate((np.arange(len(ends)), text)), np.concatenate((np.zeros(len(ends), np.int64), own))
    order = np.lexsort((start, text))
    return text[order], start[order]


def count_tokens(docs: DataFrame, *, tokenizer_path: str | None = None, special_as_text: bool = False, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """One row a section: doc_id, section (from 0), start, end, n_tokens, n_crossing, doc_tokens; positions in code points.

    Args:
        docs: doc_id long, text string; other columns are ignored unless named in `sections`, whatever their names.
        special_as_text: whether a special token's string in a text is ordinary text and not that token.
        sections: the column with the ascending section starts (array of int) of a text; by default sections are lines.
            A missing, null or empty array makes the text one section; 0 is put in front; starts beyond the text are
            sections without characters.
        rule: "majority", "first" or "last": whose a token is that crosses boundaries.
    A null text counts as empty: one section without characters or tokens. Repeated rows are counted each. An empty
    table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    common.text_batches(docs.sparkSession)
    path = tokenizer_path or tokens.default_path()
    bounds = F.col(sections).cast("array<long>") if sections else F.lit(None).cast("array<long>")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"), bounds.alias("bounds"))
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, special_as_text)
        for whole in common.lean(batches):
            for batch in tokens.slices(whole):
                texts = batch.column("text")
                encoded = encoder.encode(texts)
                sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes)
                offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
                data = np.frombuffer(texts.buffers()[2], np.uint8, int(ends[-1]), int(offsets[0])) if ends[-1] else np.zeros(0, np.uint8)
                place = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) - np.int32(1)  # the character of each byte
                text, start = _lines(data, place, ends, chars) if sections is None else _given(batch.column("bounds"))
                limits = np.append(start[1:], 0)
                last = np.append(text[1:] != text[:-1], True)
                limits[last] = np.maximum(chars[text[last]], start[last])
                # Sections of the whole batch by character; those beyond their text hold none and start at its end.
                before = np.cumsum(chars) - chars
                at = before[text] + np.minimum(start, chars[text])
                section_of = np.cumsum(np.bincount(at, minlength=int(chars.sum()) + 1), dtype=np.int32)[:-1] - np.int32(1)
                widths = encoder.width[encoded.ids]
                token_ends = np.cumsum(widths, dtype=np.int32)
                token_starts = token_ends - widths
                held, crossing = attribute(token_starts, token_ends, np.append(at, int(chars.sum())), rule, section_of[place], place)
                counts = np.bincount(text, minlength=len(texts))
                number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                columns = [batch.column("doc_id").take(pa.array(text)), *(pa.array(np.asarray(c, np.int64)) for c in (number, start, limits, held, crossing, encoded.counts[text]))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain.mapInArrow(counted, ", ".join(f"`{n}` long" for n in names))
