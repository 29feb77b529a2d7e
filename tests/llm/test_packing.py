import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chapterloom.llm import packing, tokens

TEXTS = ["", None, "a", "Hello, world.  Two  blanks\n and it's é ", "the cat, the dog.\n\nthe end", " lead and trail ", "x" * 9000, "<|endoftext|> is text", "tab\t and\x1c odd　 blanks"] + ["same words again and again."] * 30


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, part int")


def test_units_equal_whole_texts():
    whole = Tokenizer.from_file(tokens.default_path())
    texts = [t or "" for t in TEXTS] + ["Mr. Ö's 1,234.5 words...don't,, 'll.", "a.\n b", "ok, \tgo"]
    for special in (False, True):
        encoder = tokens.BatchEncoder(tokens.default_path(), special)
        whole.encode_special_tokens = special
        wanted = [whole.encode(text, add_special_tokens=False).ids for text in texts]
        for _ in range(2):  # the second time words are known
            found = encoder.encode(pa.array(texts), 1)
            assert found.counts.tolist() == [len(w) + 1 for w in wanted]
            assert found.ids.tolist() == [i for w in wanted for i in [*w, 1]]
        widths = encoder.width[encoder.encode(pa.array(texts)).ids]
        assert widths.sum() == sum(len(t.encode()) for t in texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÉ7'st.,\n\t\u3000\x85 🙂", max_size=40), max_size=6))
def test_any_texts(texts):
    encoder = tokens.encoder(tokens.default_path())
    found = encoder.encode(pa.array(texts, pa.string()))
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert found.counts.tolist() == [len(w) for w in wanted] and found.ids.tolist() == [i for w in wanted for i in w]


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 6)
    encoder = tokens.BatchEncoder(tokens.default_path())
    for k in range(8):
        text = f"the same words w{k} x{k} y{k} z{k} the same"
        assert encoder.encode(pa.array([text])).ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert "same" in encoder.known and len(encoder.known) <= 12


def test_pieces_cover_every_document_once(spark):
    whole = Tokenizer.from_file(tokens.default_path())
    found = packing.pack(rows(spark, TEXTS), length=64, partitions=3).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.pack(rows(spark, [])).count() == 0


def test_hilbert_visits_each_cell_in_unit_steps():
    grid = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    order = grid[np.argsort(packing.hilbert(grid, bits=2))]
    assert sorted(packing.hilbert(grid, bits=2)) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
