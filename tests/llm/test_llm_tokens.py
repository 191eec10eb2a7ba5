"""The SentencePiece codec against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from incidentlab.llm import spiece
from incidentlab.llm.queries import tokenizer_path

from llm_fixtures import awkward, awkward_rows, nothing

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
with open(tokenizer_path(), "rb") as _f:
    CODEC = spiece.Codec(_f.read())


def same(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "\n", "\n\n a\n", " \n", "a \nb", "▁", "▁ a▁",
                                  "<s>", "</s> <unk> <0x41>", "é\x00x", "Ａ①", "🙂🙂 中文", " " * 77, "a" * 900,
                                  "�", "tab\tand\rreturn", "x" + " " * 33 + "y" + " " * 17])
def test_texts_by_hand(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tabcdetion.,▁é中🙂0<>")), st.characters(codec="utf-8")),
               max_size=60))
def test_any_text(text):
    same(text)


def test_joined_pieces():
    r = random.Random(2)
    for _ in range(1500):
        same("".join(r.choice(CODEC.model.pieces[300:]).replace("▁", " ") for _ in range(r.randint(1, 9))))


def test_compatibility_is_what_merging_says():
    r = random.Random(3)
    ids = list(CODEC.model.ids.values())
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        want = [CODEC.model.pieces[a], CODEC.model.pieces[b]]
        assert CODEC._compatible(a, b) == (CODEC.merged("".join(want)) == want)


def test_decode_of_unnatural_ids():
    r = random.Random(4)
    for _ in range(800):
        ids = [r.randint(259, 31_999)] + [r.choice([r.randint(3, 258), r.randint(259, 31_999)])
                                          for _ in range(r.randint(0, 8))]
        assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_operator_on_awkward_rows(spark):
    got = spiece.encode_documents(awkward(spark), tokenizer_path()).collect()

    def want(i, text):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), ids, LIBRARY.decode(ids))
    rows = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded) for r in got]
    assert sorted(rows, key=str) == sorted((want(r[0], r[1]) for r in awkward_rows()), key=str)
    assert spiece.encode_documents(nothing(spark), tokenizer_path()).count() == 0


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(spiece, "MEMO_ENTRIES", 5)
    codec = spiece.Codec(open(tokenizer_path(), "rb").read())
    text = " ".join(f"word{k}" for k in range(40))
    assert codec.encode(text) == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert len(codec._parts) <= 5
