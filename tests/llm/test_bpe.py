import random

import public_tokenizers as P
import tiktoken

from keystrata.llm import bpe as B

COLS = "doc_id long, text string, ids string, decoded string"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_round_trip_against_library(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_CHARS", 3000)
    r = random.Random(2)
    bits = ["the ", "Straße", " 日本語", "\n\n", "  ", "'s", "12345", "\x1c", "\x85", "\xa0", "é", "🙂", "<|endoftext|>", "!?", "\t", "don't ", "ǅ"]
    docs = [(k, "".join(r.choice(bits) for _ in range(r.randrange(200))), "x", "y") for k in range(150)]
    docs += [(None, None, "x", None), (3, "", None, None), (3, "same", None, None), (3, "same", None, None), (9, "ab" * 4000, None, None), (10, "the " * 5000, None, None)]
    ranks = B.read_ranks(PATH)
    got = B.decode(B.encode(spark.createDataFrame(docs, COLS), ranks, P.PATTERN), ranks).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), b"".join(i.to_bytes(4, "little") for i in ids), (t or "").encode()

    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((x.doc_id, x.n_tokens, bytes(x.ids), bytes(x.decoded)) for x in got), key=key) == sorted(((d, *want(t)) for d, t, *_ in docs), key=key)


def test_empty(spark):
    ranks = B.read_ranks(PATH)
    assert B.encode(spark.createDataFrame([], COLS), ranks, P.PATTERN).collect() == []


def test_pattern_agrees_on_every_character():
    import regex

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})
    find = regex.compile(P.PATTERN).findall
    for k in range(0, 0x30000):
        if 0xD800 <= k < 0xE000:
            continue
        t = f"a{chr(k)}b {chr(k)} 1"
        assert [i for w in find(t) for i in enc._core_bpe.encode_single_piece(w.encode())] == enc.encode_ordinary(t), hex(k)
