"""The pipeline against a brute-force version, stage by stage, in plain Python."""

import glob
import hashlib
import os
import random

import public_tokenizers as T
import tiktoken

from keystrata.llm import bpe, decontam, neardup, quality


def make(tmp_path, spark):
    r = random.Random(8)
    words = [f"word{k}x" for k in range(3000)]
    prose = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(20)) + "." for _ in range(n))
    junk = lambda: "\n".join(" | ".join(f"w{r.randrange(900)}%%%" for _ in range(15)) for _ in range(6))
    items = [(k, " ".join(r.choice(words) for _ in range(25))) for k in range(5)]
    docs = []
    for k in range(60):
        text = prose(r.randrange(3, 9))
        if k % 10 == 1:
            text += "\n" + items[k % 5][1]
        if k % 10 == 2:
            text += '\nwrite to a.b@c.de, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
        docs.append((k, text))
    docs += [(100 + k, junk()) for k in range(30)] + [(200 + k, docs[k][1]) for k in range(8)] + [(300, None), (None, prose(5)), (5, prose(4)), (2, docs[2][1])]
    labels = [(k, 1, 0) for k in range(30)] + [(100 + k, 0, 0) for k in range(15)]
    rows = [(d, t, "en", "src0", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    docs, items = make(tmp_path, spark)
    crf = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(d, t) for d, t in docs if quality.judge(t, crf)[6]]
    sets = [decontam.shingles((t or "").encode().lower().split()) for _, t in kept]
    up = list(range(len(kept)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(kept)):
        for j in range(i):
            if sets[i] == sets[j] or neardup.similar(sets[i], sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(kept)):
        groups.setdefault(root(i), []).append(kept[i])
    alone = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    wanted = [decontam.shingles(decontam.words_of(q)) for _, q in items]
    clean = [(d, t) for d, t in alone if not any(len(w & decontam.shingles(decontam.words_of(t))) >= 0.8 * len(w) for w in wanted)]
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=bpe.read_ranks(T.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for d, t in clean:
        t = t.replace("a.b@c.de", "[EMAIL]").replace("04dbebab91ab85687d33eeaaf9ac699e1188f962", "[SECRET]")
        ids = enc.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(x) for x in P.run(spark, str(tmp_path)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {d for d, *_ in want} < {d for d, _ in docs}
    from keystrata.llm._common import shared_folder

    left = [sorted(os.listdir(f)) for f in glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*")]
    assert left and all(f == ["4_encode_tokens"] for f in left)


def test_stages_keep_columns_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
