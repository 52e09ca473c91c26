"""The encoder: the size of its tables and blocks changes no ids, nor do odd texts; words are encoded once."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm import tokens


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_small_tables_change_no_ids(name, drops, monkeypatch):
    texts = [" ".join(f"w{k % 37}é Ab{k}, ß{k % 5}!  x\ty" for k in range(n)) + "\n\n" for n in (0, 1, 50, 300)] * 2
    full = tokens.Encoder(public_tokenizers.path(name), drops).ids(texts)
    monkeypatch.setattr(tokens.Encoder, "LIMIT", 20)
    small = tokens.Encoder(public_tokenizers.path(name), drops)
    assert small.ids(texts) == full and small.pieces_known.older


#: Text whose parts are easily told wrongly: marks that may begin an added token, contractions, letters beyond
#: Latin-1 and combining marks beside plain ones, other digits, controls, white space of all kinds at all places.
ODD = ["a", "B", "É", "ß", "×", "÷", "ÿ", "é", "e\u0301", "Å", "ſ", "İ", "Σ", "中", "🙂", "²", "7", "42", "\x00", "\x7f", "'s", "'", "’", ".", ",!", "<|", "<", "|", "|>", "<|ENDOFTEXT|>", "<|endoftext|>", " ", " ", " ", "\n", "  ", "\n\n", "   ", "\t", "\xa0", "\u2028"]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_odd_texts_in_blocks_as_the_whole_tokenizer(name, drops, monkeypatch):
    path, rng = public_tokenizers.path(name), random.Random(7)
    texts = ["", " ", "\n", "word", "Word \n", "<|ENDOFTEXT|>", *("".join(rng.choices(ODD[: rng.choice([8, 20, len(ODD)])], k=rng.randrange(25))) for _ in range(3000)), ""]
    texts += ["".join(rng.choices([*ODD[:7], *ODD[16:18], ".", ",!", " ", " ", "\n"], k=rng.randrange(25))) for _ in range(1000)]
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for chunk in (1, 300, 4_000_000):
        monkeypatch.setattr(tokens.Encoder, "CHUNK", chunk)
        found = [array("H", ids).tolist() for ids in tokens.Encoder(path, drops).ids(texts)]
        assert [(t, f, w) for t, f, w in zip(texts, found, want, strict=True) if f != w] == []


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_words_are_encoded_once_whatever_marks_follow(name, drops):
    coder = tokens.Encoder(public_tokenizers.path(name), drops)
    coder.ids(["\n".join(f" word{'x' * k}{mark}" for k in range(20) for mark in (".", ",", ";", "!", "?", ""))])
    assert len(coder.pieces_known) <= 20 + 5 + 1
