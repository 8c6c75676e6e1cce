import random

import xxhash

from keystrata.llm import simhash as S

COLS = "doc_id long, text string, fp string"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in sh) > len(sh):
            out |= 1 << bit
    return out


def brute(docs):
    fps = [brute_fp(t) for _, t, *_ in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d is None, d or 0, fps[i], least.get(root(i)) or 0) for i, (d, *_) in enumerate(docs))


def make():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 40, 200]))]
        docs.append((len(docs) + 5000, " ".join(base), "x"))
        for _ in range(r.randrange(4)):
            other = list(base)
            other[r.randrange(len(other))] = r.choice(words)
            docs.append((len(docs), " \n".join(other).upper(), "x"))
    docs += [(999, None, "x"), (998, "  \t", "x"), (None, "w1 w2 w3", None), (7005, "dup dup dup", "x"), (7005, "dup dup dup", "x")]
    docs += [(2000 + k, "hot copy of a text", "x") for k in range(100)]
    return docs


def test_components_against_brute_force(spark):
    docs = make()
    got = S.components(spark.createDataFrame(docs, COLS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id or 0) for r in got) == brute(docs)


def test_split_trees_lose_no_link(spark):
    r = random.Random(1)
    centre = [r.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centre for _ in range(80)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    from keystrata.llm.components import connected_components

    whole = {}
    for size in (5, 4096):
        e = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tree_size=size)
        whole[size] = sorted((x.node, x.root) for x in connected_components(e).collect())
    assert whole[5] == whole[4096]
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert dict(whole[5]) == {f: root(f) for f in fps if any(root(g) == root(f) for g in fps if g != f)}


def test_tree_search():
    r = random.Random(2)
    values = [r.getrandbits(12) for _ in range(300)]
    t = S.BKTree()
    for v in values:
        t.add(v)
    for q in range(0, 4096, 97):
        assert sorted(t.values[k] for k in t.within(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})
