"""Simple-8b and token files: exact round trips."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from llm.fixtures import none, odd, rows
from tokenizers import Tokenizer

from millrace.llm import simple8b
from millrace.llm.queries import op1_token_output, tokenizer_path
from millrace.llm.token_output import Encoder, read_ids, read_index, write_tokens


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("most", [1, 2, 300, 50257, 1 << 33, (1 << 64) - 1])
def test_words_hold_the_ids(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64)
    words, offsets, escapes = simple8b.encode(ids)
    assert (simple8b.decode(words, escapes) == ids).all()
    for i, (a, b) in enumerate(zip(offsets, [*offsets, len(words)][1:], strict=True)):
        assert (simple8b.decode(words[a:b], escapes) == ids[i * simple8b.BLOCK : (i + 1) * simple8b.BLOCK]).all()
    assert len(escapes) == (ids >= 1 << 60).sum()


def test_small_ids_share_words():
    words, _, _ = simple8b.encode(np.zeros(6000, np.uint64))
    assert len(words) == 6000 // 1024 * -(-1024 // 60) + len(simple8b.encode(np.zeros(6000 % 1024, np.uint64))[0])


ODD = [
    "a  b", " x", "x ", "\n\n a\n b", "it's we'll\t\tgo  ", "a\x1cb \x1c c", "a b  c　d", "  ", "",
    "\r\n\r\nab", "naïve  \n x123 456 !!??  <|endoftext|> y", "x\x85y \x85 z", "a.b, (c) 'd' e's\n.f", "½² x́y",
]


def test_pieces_encode_as_the_whole():
    texts = ODD + [r[1] for r in rows() if r[1]]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    whole = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(tokenizer_path()).encode(texts) == whole


def test_special_tokens_and_small_caches(monkeypatch):
    """The library's own ids, also where a text names a special token and where little is remembered."""
    monkeypatch.setattr("millrace.llm.token_output.CACHE_ENTRIES", 8)
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|>\n y", *ODD, "end. End, é! ß; ªº µ", "l'été. It's."]
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(encoder.encode([text, "word. word"])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_not_cut_one_by_one(monkeypatch):
    """Texts without white space beyond ASCII are cut and looked up together, over arrays."""
    monkeypatch.setattr("millrace.llm.token_output._PIECE", None)
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    texts = ["Word, word.\n\nWord  x1 don't", "", "été× 字 a\x00 a", "a sixteen-byte-word-and-a-longerwordthanthat, " * 3]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("entries, at_once, held", [(2, 1, 1), (8, 5, 40), (200_000, 1 << 16, 1 << 22)])
def test_any_text_encodes_as_the_library_does(monkeypatch, entries, at_once, held):
    for name, value in (("CACHE_ENTRIES", entries), ("PIECES_AT_ONCE", at_once), ("BYTES_AT_ONCE", held)):
        monkeypatch.setattr(f"millrace.llm.token_output.{name}", value)
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    letters = list("abzAZéßÿ×÷ \n\t\r\x0b\x1c'’.,!-_09²\u0301\u0085\u3000“字😀\x00ª's st re ")
    some = np.random.default_rng(5)
    for size in (1, 3, 20, 150):
        texts = ["".join(some.choice(letters, some.integers(0, size + 1))) for _ in range(40)]
        found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
        assert found == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def _expected(data: list[tuple]) -> list[tuple]:
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for doc, text in sorted(((r[0], r[1] or "") for r in data), key=lambda r: (r[0] is not None, r[0], r[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [50, 1 << 18])
def test_files_hold_all_documents_in_order(spark, folder, segment_ids):
    write_tokens(odd(spark), f"{folder}/t", tokenizer_path(), 2, segment_ids)
    expected = _expected(rows())
    index = sorted(map(tuple, read_index(spark, f"{folder}/t").collect()), key=lambda r: r[1])
    assert index == [r[:4] for r in expected]
    found = sorted((str(r.doc_id), r.ids) for r in read_ids(spark, f"{folder}/t").collect())
    assert found == sorted((str(r[0]), r[4]) for r in expected)


def test_empty_table(spark, folder):
    write_tokens(none(spark), f"{folder}/t", tokenizer_path(), 2)
    assert read_index(spark, f"{folder}/t").count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    expected = {r[:4] for r in _expected([(d.doc_id, d.text) for d in docs])}
    assert set(map(tuple, op1_token_output(spark, "/root/testdata/sf0.001").collect())) == expected
