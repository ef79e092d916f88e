import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ossicle.llm import packing
from ossicle.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, row long, length string, g int"


def test_encoder_agrees_with_the_library():
    lib, enc = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "́", "9", "½", "!", " ", "　", "<|endoftext|>", "中", "😀", "\x00"]
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, docs, capacity):
    lib = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append([*lib.encode(t or "", add_special_tokens=False).ids, 0])
    places, got = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 1 <= r.length <= capacity
        places[r.sequence_id].append((r.offset, r.length))
        part = [x[r.start : r.start + r.length] for x in ids[r.doc_id]]
        assert any(zlib.crc32(np.array(p, "<u4").tobytes()) == r.ids_crc32 for p in part)
        got[r.doc_id] += r.length
        assert r.piece == 0 or r.length == capacity
    assert got == {d: sum(map(len, x)) for d, x in ids.items()}
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(places)


def test_packs_every_piece_gaplessly(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("word%d" % rng.randrange(50) for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (None, "null id"), (7, docs[7][1]), (502, "long text here " * 2000)]
    frame = spark.createDataFrame([(d, t, "p", 1, "n", 2) for d, t in docs], SCHEMA)
    for group in (40, packing.GROUP):
        cut = packing.pieces(frame, PATH, 128, 0)
        rows = packing.packed(cut, 128, group).collect()
        used = check(rows, docs, 128)
        assert used <= 1.02 * sum(r.length for r in rows) / 128 + 2


def test_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_local_search_improves_best_fit():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2] * 3
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 100) for _ in range(40)] if seed else lengths
        first = packing.best_fit(sizes, 100 if seed else 10)
        bins = packing.improve([list(b) for b in first], sizes, 100 if seed else 10)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= (100 if seed else 10) for b in bins)
        assert len(bins) <= len(first)
