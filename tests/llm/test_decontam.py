import random

from keystrata.llm import decontam as D

COLS = "doc_id long, text string, th string, keys int"


def brute(docs, items, share=0.8):
    out = set()
    for d, t, *_ in docs:
        own = D.shingles(D.words_of(t))
        for i, q in items:
            s = D.shingles(D.words_of(q))
            if s and len(s & own) >= share * len(s):
                out.add((d, t, i, len(s & own), len(s)))
    return sorted((d is None, d or 0, *x) for d, _, *x in out)


def make():
    r = random.Random(9)
    words = [f"wörd{k}" for k in range(3000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(r.choice([3, 5, 16, 30, 59, 200])))) for k in range(60)] + [(90, None), (91, ""), (92, "short one"), (93, "short one")]
    docs = []
    for k in range(200):
        body = say(r.choice([10, 300, 4000]))
        if k % 2:
            q = r.choice(items)[1] or "x"
            q = q.split()
            if k % 4 == 1 and len(q) > 20:
                q[r.randrange(len(q))] = "changed"
            at = r.randrange(len(body))
            body[at:at] = q
        docs.append((k, " ".join(body).upper().replace(" ", ", ", 5), "x", 1))
    docs += [(None, items[5][1], "x", 1), (777, None, None, None), (778, "", "x", 1), (5, items[7][1], "x", 1), (5, items[7][1], "x", 1), (6, "Short one!", "x", 2)]
    docs += [(1000 + k, "hot " + items[8][1], "x", 1) for k in range(120)]
    return docs, items


def test_all_found_against_brute_force(spark):
    docs, items = make()
    d, i = spark.createDataFrame(docs, COLS), spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(d, i).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.item_id, x.n_shared, x.n_shingles) for x in got) == brute(docs, items)
    bad = {t for d_, t, *_ in docs for x in [brute([(d_, t)], items)] if x}
    left = D.decontaminate(d, i)
    assert left.columns == d.columns and sorted(x.text or "" for x in left.collect()) == sorted(t or "" for _, t, *_ in docs if t not in bad)


def test_empty(spark):
    d, i = spark.createDataFrame([], COLS), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contamination(d, i).collect() == [] and D.decontaminate(d, i).collect() == []
    d = spark.createDataFrame([(1, "a b c d e f", "x", 1)], COLS)
    assert D.contamination(d, i.limit(0)).collect() == [] and D.decontaminate(d, i.limit(0)).count() == 1


def test_sql_agrees(spark):
    import duckdb
    import pyarrow as pa

    docs, items = make()
    t = pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]})  # noqa: F841
    b = pa.table({"item_id": [d[0] for d in items], "text": [d[1] for d in items]})  # noqa: F841
    got = duckdb.sql(D.ORACLE.format(docs="t", items="b")).fetchall()
    assert sorted((x[0] is None, x[0] or 0, *x[1:4]) for x in got) == brute(docs, items)


def test_short_items_in_long_documents(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(5 + k % 4))) for k in range(600)]
    docs = []
    for k in range(150):
        body = say(300)
        for _ in range(20):
            at = r.randrange(len(body))
            body[at:at] = r.choice(items)[1].split()
        docs.append((k, " ".join(body), "x", 1))
    got = D.contamination(spark.createDataFrame(docs, COLS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.item_id, x.n_shared, x.n_shingles) for x in got) == brute(docs, items)


def test_scattered_and_repeated_shingles(spark):
    """Items spread over a long document in pieces of one shingle, or made of repeated ones, are found as well."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(9000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, say(r.choice([12, 30, 60]))) for k in range(60)] + [(100 + k, say(6) * 12) for k in range(20)]
    docs = []
    for k, q in items:
        pieces = [q[j : j + 5] for j in range(len(q) - 4)]
        r.shuffle(pieces)
        lost = len(pieces) // 5 if k % 2 else len(pieces) // 3
        docs.append((k, " ".join(w for piece in pieces[lost:] for w in [*say(40), *piece, *say(40)]), "x", 1))
    items = [(k, " ".join(q)) for k, q in items]
    got = D.contamination(spark.createDataFrame(docs, COLS), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.item_id, x.n_shared, x.n_shingles) for x in got) == want and len(want) > 30


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two three four five six", "a", "b", "c"), (2, "clean text", "a", "b", "c")], "doc_id long, text string, _th string, TH string, th_ string")
    left = D.decontaminate(d, spark.createDataFrame([(1, "one two three four five")], "item_id long, text string"))
    assert [tuple(x) for x in left.collect()] == [(2, "clean text", "a", "b", "c")] and left.columns == d.columns
