"""Ids are those that the tokenizers library gives for the whole text."""

import random
import time

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ossicle.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "'", "s", "t", "'ll", "re", " ", "  ", "\n", "\r", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "᠎", "​", "⁠", "　", " ", "﻿", "a", "\xe9", "\xdf",
    "B", "1", "\xb2", "\xbd", "中", "٣", "́", "\U0001f600", "!", ",", "_", "-", "`", "{", "\x00", "\x7f", "\xaa", "\xd7", "ʼ", "don't", "ſ", "K", "<|endoftext|>",
]


def whole(text, lib=Tokenizer.from_file(PATH)):
    return lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng, enc = random.Random(seed), tokens.Encoder(PATH)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(16)))
        assert enc.encode(text).tolist() == whole(text), ascii(text)


def test_every_code_point_of_the_lower_planes():
    enc = tokens.Encoder(PATH)
    for at in range(0, 0x3100, 64):
        text = "".join(f"a{c} b{c}!{c}\n{c}" for c in map(chr, range(at, at + 64)))
        assert enc.encode(text).tolist() == whole(text), hex(at)


def test_documents_of_the_tables():
    enc = tokens.Encoder(PATH)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert enc.encode(text or "").tolist() == whole(text or "")


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 3_000_000, "a" * 1_000_000, "\xe9" * 200_000, "! " * 300_000, " \n" * 300_000 + "end"])
def test_very_long_runs(text):
    assert tokens.Encoder(PATH).encode(text).tolist() == whole(text)


def test_units_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_UNITS", 50)
    enc = tokens.Encoder(PATH)
    for i in range(300):
        text = f"word{i} and {'x' * i} {i}"
        assert enc.encode(text).tolist() == whole(text)
    assert len(enc.units) <= 50 and max(map(len, enc.units)) <= tokens.LONGEST


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_other_kinds_of_files_go_to_the_library(tmp_path, change):
    import json

    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    spec["pre_tokenizer"] |= change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc = tokens.encoder(str(tmp_path / "t.json"))
    assert enc.units is None and enc.encode("two words").tolist() == enc.tokenizer.encode("two words", add_special_tokens=False).ids


@pytest.mark.parametrize("slots", [2, 64, 1 << 21])
def test_many_texts_at_once(monkeypatch, slots):
    monkeypatch.setattr(tokens, "SLOTS", slots)
    rng, enc = random.Random(slots), tokens.Encoder(PATH)
    words = [" the", "\nÎle", " çà", ".", "×", "÷a", "A\x00", "\x00", "a\xa0", " " + "x" * 13, " " + "x" * 14, " " + "x" * 15, "\xe9" * 8, "\xc3", "中 b", *PARTS]
    for _ in range(300):
        texts = ["".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 40]))) for _ in range(rng.randrange(9))]
        assert [x.tolist() for x in enc.encode_all([t.encode() for t in texts])] == [whole(t) for t in texts]
    assert enc.table.taken <= slots


def test_bytes_that_are_no_text():
    texts = [b"a \xff b", b"\xc3", b"\xa9 c", "\xe9".encode(), b""]
    assert [x.tolist() for x in tokens.Encoder(PATH).encode_all(texts)] == [whole(t.decode("utf-8", "replace")) for t in texts]


def test_units_met_again_are_not_encoded_again():
    enc, text, took = tokens.Encoder(PATH), " ".join(f"w{i}" for i in range(600_000)), []
    for _ in range(2):
        began = time.thread_time()
        enc.encode(text)
        took.append(time.thread_time() - began)
    assert took[1] < took[0] / 2
