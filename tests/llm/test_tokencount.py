import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from keystrata.llm import tokencount as C

PATH = P.path("byte_bpe_50k.json")


def library_ends(t):
    return lambda x: np.array([len(x[: e].encode()) for _, e in t.encode(x, add_special_tokens=False).offsets], dtype=np.int64)


def test_chunks_equal_whole_texts():
    t, fast = Tokenizer.from_file(PATH), C.rank_encoder(PATH)
    r = random.Random(3)
    bits = ["the ", " word", "日本", "\n", "  ", "\t ", "<|endoftext|>", "é", "🙂", "12 ", "'s", "longwordwithoutend" * 3, "\xa0", "\x1c ", "!!! ", "'", "'re", "a1b2", "、", "--x", "endoftext|>", "<|"]
    for n in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randrange(400)))
        sizes = r.choice([20, 50, 300]), r.choice([4, 16, 40])
        assert C.count_long(text, fast.ends, *sizes, special=fast.special) == len(t.encode(text, add_special_tokens=False)), n
    for text in ("x" * 5000, " " * 5000, "a\n" * 3000, "<|endoftext|>" * 500, "no blank" + "z" * 3000 + " end", "'s" * 2000, "日本語。" * 2000, "a1" * 3000):
        whole = len(t.encode(text, add_special_tokens=False))
        assert C.count_long(text, fast.ends, 100, 10, fast.special) == whole == fast.count(text)
    text = "some words, and more! " * 200  # the library's offsets serve as well
    assert C.count_long(text, library_ends(t), 100, 10) == len(t.encode(text, add_special_tokens=False))


def test_text_without_blanks_is_held_in_chunks():
    fast, seen = C.rank_encoder(PATH), []
    text = "日本語、abc123;" * 20_000
    ends = lambda x: seen.append(len(x)) or fast.ends(x)
    assert C.count_long(text, ends, special=fast.special) == len(fast.ends(text))
    assert max(seen) <= C.CHUNK + 2 * C.OVERLAP


def test_other_files_go_to_the_library(spark, tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"][0]["content"] = "<| end |>"
    path = f"{tmp_path}/odd.json"
    json.dump(spec, open(path, "w", encoding="utf-8"))
    assert C.rank_encoder(path) is None
    t = Tokenizer.from_file(path)
    docs = [(k, "some <| end |> words " * n) for k, n in enumerate((0, 1, 3000))]
    got = {x.doc_id: x.n_tokens for x in C.token_counts(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False)) for k, x in docs}


def test_query_form(spark):
    t = Tokenizer.from_file(PATH)
    docs = [(1, "a b", 5), (None, None, 5), (2, "", None), (3, "some words and é " * 9000, 1), (3, "word " * 600, 1), (3, "word " * 600, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens long")
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_tokens, x.over_limit) for x in C.token_counts(df, PATH).collect())
    want = [(d or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for d, x, _ in docs]
    assert got == sorted((*w, w[2] > 512) for w in want)
    assert C.token_counts(df.limit(0), PATH).count() == 0


def test_rank_encoder_agrees_with_the_library(sf):
    import pyarrow.parquet as pq

    t, fast = Tokenizer.from_file(PATH), C.rank_encoder(PATH)
    whole = lambda x: len(t.encode(x, add_special_tokens=False))
    for k in range(0, 0x30000):
        if not 0xD800 <= k < 0xE000:
            x = f"a{chr(k)}b {chr(k)} 1{chr(k)}"
            assert fast.count(x) == whole(x), hex(k)
    for x in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist():
        assert fast.count(x) == whole(x)
    assert fast.count("<|endoftext|> a<|endoftext|>") == whole("<|endoftext|> a<|endoftext|>")
    assert C.rank_encoder(P.path("word_bpe_49k.json")) is None
