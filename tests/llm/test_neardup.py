import random

from keystrata.llm import neardup as N

COLS = "doc_id long, text string, lang string"


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """doc_ids left: components of all pairs at Jaccard 0.8 or more."""
    own, up = [sets(t) for _, t, *_ in docs], list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return sorted(min((d is None, d or 0) for d in g) for g in groups.values())


def make():
    r = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    line, docs = say(12), []
    for _ in range(60):
        base = say(r.choice([1, 4, 5, 9, 40, 120, 300])) + line * r.randrange(2)
        docs.append((len(docs), " ".join(base), "x"))
        for _ in range(r.randrange(4)):  # similarities on both sides of 0.8
            other = list(base)
            for _ in range(r.randrange(1, max(2, len(base) // 25))):
                other[r.randrange(len(other))] = r.choice(words)
            docs.append((len(docs), " \n\t".join(other).upper(), "x"))
    docs += [(9000, None, "x"), (8999, " \t", "x"), (None, docs[0][1], "x"), (None, " ".join(say(30)), "x"), (7, docs[7][1], "x"), (7, docs[7][1], "x")]
    return docs + [(5000 + k, "one hot copy of a text", "x") for k in range(50)]


def test_pipeline_stage_against_brute_force_jaccard(spark):
    import corpus_pipeline as P

    docs = make()
    got = P.near_dedup(spark, spark.createDataFrame(docs, COLS), "")
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect()) == brute(docs)
    assert P.near_dedup(spark, spark.createDataFrame([], COLS), "").count() == 0


def test_links_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    rows += [(d + 10**6, " ".join(w for k, w in enumerate(t.split()) if k % 97 != 50)) for d, t in rows[:100]]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert sorted((False, x.doc_id) for x in got) == brute(rows)


def test_clashing_names_and_many_near_copies(spark):
    """A list of 120 near copies, longer than a tile here, and texts that share only a passage."""
    r = random.Random(2)
    words = [f"v{k}" for k in range(4000)]
    base, passage = [r.choice(words) for _ in range(150)], [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(120):
        own = list(base)
        own[r.randrange(150)], own[r.randrange(150)] = "n1", f"u{k}"
        rows.append((k, " ".join(own), "a", "b", 1))
    rows += [(1000 + k, " ".join([*passage, *(r.choice(words) for _ in range(60))]), "a", "b", 2) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, _k string, h int")
    out = N.near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((False, x.doc_id) for x in out.collect()) == brute(rows)


def test_tiles_lose_no_pair(spark):
    r = random.Random(5)
    rows = [(t, k, 20 + r.randrange(4), 0, None) for t in range(3) for k in range(40 * t, 40 * t + 37)]
    met = spark.createDataFrame(rows, "token long, s long, n int, pos int, before long")
    roots = spark.createDataFrame([(k, k - k % 5) for k in range(120) if k % 5], "node long, root long")
    want = {(a, b) for t, a, n, *_ in rows for u, b, m, *_ in rows if t == u and a < b and a - a % 5 != b - b % 5 and 5 * min(n, m) >= 4 * max(n, m)}
    for tile in (1000, 8):
        assert {tuple(x) for x in N.other_pairs(met, roots, tile).collect()} == want


def test_sketches_refuse_no_similar_pair():
    import numpy as np

    g = np.random.default_rng(1)
    for _ in range(300):
        n = int(g.integers(1, 400))
        a = np.unique(g.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(g.integers(0, n // 4 + 1)) :], g.integers(0, 1 << 62, int(g.integers(0, n // 4 + 1))).astype(np.uint64)]))
        ok = N.similar(set(a.tolist()), set(b.tolist()))
        assert N.may_be_similar(N.sketch(a), N.sketch(b), len(a), len(b)) or not ok
    far = g.integers(0, 1 << 62, 300).astype(np.uint64)
    near = np.unique(far)
    assert not N.may_be_similar(N.sketch(near), N.sketch(np.unique(np.concatenate([near[:200], near[:100] + np.uint64(1)]))), 300, 300)
