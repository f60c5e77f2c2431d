import random
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shardloom.llm import packing, tokens
from shardloom.llm.tokens import WordCache

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, rest string"


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    t, own = Tokenizer.from_file(PATH), WordCache(PATH)
    alphabet = [chr(i) for i in range(256)] + list("'sdtm' \n ’—ıİΣσς日本é́") + ["'ll", "<|endoftext|>", "  ", "word ", "can't"]
    for k in range(400):
        s = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert own.encode(s) == np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(s)
    assert own.encode("") == b""


def check(rows, out):
    t = Tokenizer.from_file(PATH)
    want = {}
    for d, text, *_ in rows:
        want.setdefault(d, []).append(t.encode(text or "", add_special_tokens=False).ids + [2])
    seqs = {}
    for r in out:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for d, ids in want.items():
        assert sum(p.length for p in got[d]) == sum(map(len, ids))
        if len(ids) == 1:
            joined = b"".join(p.ids for p in sorted(got[d], key=lambda p: p.start))
            assert joined == np.array(ids[0], dtype="<u4").tobytes() and {p.doc_tokens for p in got[d]} == {len(ids[0])}
    assert set(got) == set(want)


def test_round_trip(spark):
    rng = random.Random(2)
    vocab = ["tree", "Running", "é", "don't", "xqzv", "42", "。"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 300, 3000]))), "", "") for i in range(150)]
    rows += [(900, None, "", ""), (901, "", "", ""), (902, "long " * 20000, "", ""), (3, rows[3][1], "", ""), (None, "no id", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(70)
    check(rows, packing.pack(df, PATH, with_ids=True).collect())
    assert packing.pack(df, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_powers():
    out = packing.powers([("a", 0, b"\0" * 4 * 21, 21)])
    assert [sum(len(p[2]) // 4 for p in w) for w in out] == [16, 4, 1]


def test_a_cache_forgets_words_and_stays_right(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(tokens, "REMEMBER", 300)
    monkeypatch.setattr(tokens, "KEEP", 60)
    t, own = Tokenizer.from_file(PATH), WordCache(PATH)
    first = "these words come first and are met again in every text"
    for k in range(60):
        texts = [first + " " + " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(40 if k < 59 else 500)) for _ in range(2)]
        assert own.encode_many(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
        assert set(first.split()) <= own.known.keys() and (k == 59 or len(own.known) <= 300)


def test_the_memory_of_a_cache_is_bounded_on_a_large_vocabulary():
    own = WordCache(PATH)
    for i in range(0, 450_000, 5000):
        own.encode(" ".join(f"{x:06d}".translate(str.maketrans("0123456789", "abcdefghij")) for x in range(i, i + 5000)))
    assert sys.getsizeof(own.known) + sum(sys.getsizeof(w) + sys.getsizeof(b) for w, b in own.known.items()) < 45e6
