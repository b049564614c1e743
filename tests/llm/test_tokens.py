from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import MESSY, documents, messy, nothing  # noqa: F401
from tidemark.llm import packing, pieces, queries, token_counts

BYTE = queries.tokenizer_file("byte_bpe_50k.json")
WORD = queries.tokenizer_file("word_bpe_49k.json")
PIECE = queries.tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "á ̈x", "<|endoftext|><|endoftext|>  x", "\x1c\x85　 z", "it's we'll ١٢½", "ΟΔΟΣ ΟΔΟΣ.", "▁ a▁b", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "\n \n\n  \t"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_counts_are_the_librarys(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    want = {d: len(library_cached().encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    rows = queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len(texts[r.doc_id].encode()) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x3000, exclude_categories=["Cn", "Cs"]), max_size=40))
def test_counts_of_any_text(text):
    assert token_counts.merger(BYTE).count(text) == len(library_cached().encode(text, add_special_tokens=False).ids)


def library_cached(held=[]):  # noqa: B006
    if not held:
        held.append(library(BYTE))
    return held[0]


def test_counts_of_messy_rows(messy, nothing):
    found = token_counts.count_tokens(messy, BYTE).collect()
    want = sorted((str(i), len(library_cached().encode(t or "", add_special_tokens=False).ids)) for i, t in MESSY)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == want
    assert token_counts.count_tokens(nothing, BYTE).count() == 0
    assert [token_counts.merger(BYTE).count(t) for t in ODD] == [len(library_cached().encode(t, add_special_tokens=False).ids) for t in ODD]


def piece_library(held=[]):  # noqa: B006
    if not held:
        import sentencepiece

        held.append(sentencepiece.SentencePieceProcessor(model_file=PIECE))
    return held[0]


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_piece_ids_are_the_librarys(spark):
    """Every whole text of sf0.01, and odd ones."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ODD
    texts += ["", "    x     y", "漢字\U0001f600 héé", "<0x41> <s> </s> <unk>", "a" * 3000, "ab" * 5000, "z" * 70 + " zz"]
    model = pieces.piece_model(PIECE)
    assert [numbers(model.encode(t)) for t in texts] == piece_library().encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x3000, exclude_categories=["Cn", "Cs"]), max_size=40))
def test_piece_ids_of_any_text(text):
    # the library takes some characters for others only where its model says so; this one's normalisation is the identity
    assert numbers(pieces.piece_model(PIECE).encode(text)) == piece_library().encode(text)


def test_query_gives_the_librarys_pieces(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op2_sentencepiece_round_trip(spark, "/root/testdata/sf0.001").collect()
    want = {d: len(piece_library().encode(t)) for d, t in texts.items()}
    assert {r.doc_id: r.n_pieces for r in rows} == want


def test_remembered_stretches_are_bounded_in_bytes():
    model = pieces.PieceModel(PIECE, bound=20_000)
    text = " ".join(f"w{i}x" for i in range(3000)) + " " + "q" * 10_000
    assert numbers(model.encode(text)) == piece_library().encode(text)
    assert model.held <= 20_000 and max(map(len, model)) <= pieces.SHORT


def test_round_trips(spark, messy, nothing):
    back = pieces.decode(pieces.encode(messy, PIECE), PIECE)
    assert all(r.decoded == (r.text or "") for r in back.collect()) and back.count() == len(MESSY)
    assert pieces.decode(pieces.encode(nothing, PIECE), PIECE).count() == 0
    model = pieces.piece_model(PIECE)
    for text in ODD:
        ids = np.frombuffer(model.encode(text), "<i4")
        assert model.decode(ids, np.array([len(ids)])) == [text.replace("▁", " ")]
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [3 + 65, 0, 1])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in pieces.decode(nulls, PIECE).orderBy("doc_id").collect()] == [None, "", "A"]
    rows = queries.op2_sentencepiece_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**d))
        assert (np.abs(np.diff(cells[keys.argsort()], axis=0)).sum(axis=1) == 1).all()


def holds(rows, ids, length):
    """Pieces cover every document once, hold its ids, and fill sequences without a gap."""
    at, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r.start, r.sequence_id, r.offset)):
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        at.setdefault(r.doc_id, []).append(r)
    for d, rs in at.items():
        copies = ids[d]
        assert sum(r.length for r in rs) == sum(map(len, copies)) and {r.doc_tokens for r in rs} == set(map(len, copies))
    sizes = []
    for places in filled.values():
        end = 0
        for off, n in sorted(places):
            assert off == end
            end += n
        sizes.append(end)
    assert max(sizes) <= length and sum(n != length for n in sizes) <= length.bit_length()
    assert all(n == length or n & (n - 1) == 0 for n in sizes)
    assert sorted(filled) == list(range(len(filled)))


def test_packing_of_messy_rows(messy, nothing):
    lib = library(WORD)
    ids = {}
    for i, t in MESSY:
        ids.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    rows = packing.pack(messy, WORD, length=64).collect()
    holds(rows, ids, 64)
    for r in rows:
        got = [int.from_bytes(r.ids[4 * k : 4 * k + 4], "little") for k in range(r.length)]
        assert got in [x[r.start : r.start + r.length] for x in ids[r.doc_id]]
    assert packing.pack(nothing, WORD).count() == 0


def test_word_tokens_are_the_librarys():
    lib = library(WORD)
    model = packing.word_tokens(WORD)
    flat, ends = model.encode(ODD)
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in ODD]
    assert sum(map(len, packing.parts("ab " * 900_000))) == 900_001


def test_a_full_word_table_keeps_the_common_words(monkeypatch):
    lib = library(WORD)
    monkeypatch.setattr(packing, "READING_BYTES", 20_000)
    model = packing.WordTokens(WORD)
    for k in range(12):
        texts = [f"the common words of all {k * 100 + i} texts, also rare{k}x{i}" for i in range(20)]
        flat, ends = model.encode(texts)
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert "common" in model
    model.encode(["q" * 10_000 + " common"])
    model.thin(4_000)
    assert model.held <= 4_000 and "common" in model and max(map(len, model)) <= packing.SHORT
    flat, ends = model.encode(["the common words again"])
    assert flat.tolist() == lib.encode("the common words again", add_special_tokens=False).ids
    model.thin(0)
    assert not len(model) and model.encode(["anew"])[0].tolist() == lib.encode("anew", add_special_tokens=False).ids


def test_packing_query(spark, documents):
    lib = library(WORD)
    ids = {r.doc_id: [lib.encode(r.text, add_special_tokens=False).ids + [1]] for r in documents.collect()}
    rows = queries.op4_hilbert_packing(spark, "/root/testdata/sf0.001").collect()
    holds(rows, ids, 2048)
    for r in rows:
        part = ids[r.doc_id][0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))


def test_tail_is_cut_in_powers_of_two():
    assert packing.tail_cuts(2048 + 1500, 2048) == [2048 + 1024, 2048 + 1280, 2048 + 1408, 2048 + 1472, 2048 + 1488, 2048 + 1496, 2048 + 1500]
    assert packing.pieces_of(2040, 20, 2060, 2048) == [(0, 8, 0, 2040), (8, 8, 1, 0), (16, 4, 2, 0)]


def test_forms_of_a_word_are_asked_once():
    """Case and closing marks are put together again; what a mark may join, and special strings, goes to the library as it is."""
    model, asked = packing.WordTokens(WORD), []

    class Recorded:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return lib.encode_batch_fast(words, **more)

    lib, model.library = model.library, Recorded()
    texts = ["Word word, WORD. (word) word;", "word.%% été, Été. don't, it's.. 3,5. -- ...", "<|endoftext|>. a<|endoftext|> <|ENDOFTEXT|>! x' x'. İ, ñ, n,́ ,", "", None]
    for _ in range(2):
        flat, ends = model.encode(texts)
        own = [flat[s:e].tolist() for s, e in zip([0, *ends], ends)]
        assert own == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked.count("word") == 1 and not {"Word", "WORD", "word,", "WORD.", "word;"} & set(asked) and len(asked) == len(set(asked))
    assert {"<|endoftext|>.", "x'.", "İ,"} <= set(asked)


def test_long_texts_take_the_same_tokens_stretch_by_stretch(monkeypatch):
    texts = [*ODD, "", None, "some words\nand lines, " * 30]
    whole = packing.WordTokens(WORD).encode(texts)
    monkeypatch.setattr(packing, "_STEP", 8)
    cut = packing.WordTokens(WORD).encode(texts)
    assert all((a == b).all() for a, b in zip(whole, cut))
