from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import MESSY, documents, messy, nothing  # noqa: F401
from tidemark.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "á ̈x", "<|endoftext|>  x", "\x1c\x85　 z", "it's we'll ١٢½", "a" * 5000, "\n \n\n  \t", "\U0001f600\U0001f468‍\U0001f469"]


def held(cache={}):  # noqa: B006
    if not cache:
        import tiktoken

        with open(RANKS, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache["ranks"] = ranks
        cache["library"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache


def library_ids(text):
    return held()["library"].encode_ordinary(text)


def coder():
    return byte_bpe.coder(RANKS, public_tokenizers.PATTERN)


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_query_gives_the_librarys_ids(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op11_byte_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library_ids(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x3000, exclude_categories=["Cn", "Cs"]), max_size=40))
def test_any_text(text):
    assert numbers(coder().encode(text)) == library_ids(text)
    assert coder().decode(coder().encode(text)) == text


def test_odd_and_long_texts():
    for text in [*ODD, "ab" * 200_000, "x y " * 50_000]:
        assert numbers(coder().encode(text)) == library_ids(text)
        assert coder().decode(coder().encode(text)) == text


def test_runs_of_any_tokens_and_small_bounds():
    """Bytes that are no text, with states dropped all the time."""
    machine = byte_bpe.Transducer(byte_bpe.Merges(held()["ranks"]), bound=4000, settle=7)
    draw, tokens = random.Random(5), list(held()["ranks"])
    for _ in range(1500):
        data = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 6)))
        assert machine.encode(data) == held()["library"]._encode_single_piece(data)
        assert machine.held < 20_000


def test_pairs_stay_apart_if_merging_keeps_them():
    merges = byte_bpe.Merges(held()["ranks"])
    draw = random.Random(6)
    for _ in range(3000):
        a, b = draw.randrange(2000), draw.randrange(2000)
        whole = held()["library"]._encode_single_piece(merges.bytes_of[a] + merges.bytes_of[b])
        assert merges.apart(a, b) == (whole == [a, b])


def test_ranks_must_lead_to_every_token():
    plain = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        byte_bpe.Merges({**plain, b"abc": 256}).split(256)
    with pytest.raises(ValueError):
        byte_bpe.Merges({b"a": 0})


def test_remembered_pieces_are_bounded_in_bytes():
    small = byte_bpe.ByteCoder(RANKS, public_tokenizers.PATTERN, bound=20_000)
    text = " ".join(f"w{i}x" for i in range(3000)) + " " + "q" * 100_000
    assert numbers(small.encode(text)) == library_ids(text)
    assert small.held <= 20_000 and max(map(len, small)) <= byte_bpe.SHORT


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12), st.binary(max_size=6), st.lists(st.integers(0, 40), max_size=6))
def test_stream_of_bytes(text, noise, cuts):
    for data in (text.encode(), text.encode() + noise, noise + text.encode()):
        stream, at, out = byte_bpe.Utf8Stream(), 0, ""
        for cut in [*sorted(cuts), len(data)]:
            out += stream.feed(data[at : max(at, cut)])
            at = max(at, cut)
            assert data.startswith(out.encode()) or "�" in out
        assert out + stream.finish() == data.decode(errors="replace")


def test_messy_rows(spark, messy, nothing):
    coded = byte_bpe.encode(messy.drop("ids"), RANKS)
    found = [(str(r.doc_id), r.fp, r.row, None if r.ids is None else numbers(r.ids), r.decoded) for r in byte_bpe.decode(coded, RANKS).collect()]
    want = [(str(i), 5, "q", None if t is None else library_ids(t), t) for i, t in MESSY]
    assert sorted(found, key=str) == sorted(want, key=str)
    replaced = byte_bpe.encode(messy, RANKS, out="row")
    assert sorted(replaced.columns) == sorted(messy.columns) and dict(replaced.dtypes)["row"] == "binary"
    over_text = byte_bpe.encode(messy, RANKS, out="text")
    assert sorted(r.text is None for r in over_text.collect()) == sorted(t is None for _, t in MESSY)
    assert byte_bpe.decode(byte_bpe.encode(nothing.drop("ids"), RANKS), RANKS).count() == 0
    with pytest.raises(KeyError):
        coder().decode(np.array([50256], "<u4").tobytes())
