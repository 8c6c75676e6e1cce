import random
import re
from collections import Counter

import numpy as np

from keystrata.llm import quality as Q

COLS = "doc_id long, text string, kept string, _kept boolean"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_counts_against_brute_force():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["a ", "b ", "c ", "\n", "é", "\x85", "\xa0", "\x1c", "#|", "x\ty ", "日本 "]) for _ in range(r.randrange(120)))
        assert Q.judge(text, Q.LineCRF())[:6] == brute(text)
    assert Q.judge(None, Q.LineCRF())[:6] == (0, 0, 0, 0, 0, True)


def test_viterbi_against_all_paths():
    from itertools import product

    g = np.random.default_rng(0)
    crf = Q.LineCRF(g.normal(size=(2, len(Q.FEATURES))), g.normal(size=(2, 2)))
    for n in range(1, 8):
        f = [[0, *g.integers(1, 20, 2).tolist()] for _ in range(n)]

        def score(p):
            return sum(crf.emit[s, x].sum() for s, x in zip(p, f)) + sum(crf.step[a, b] for a, b in zip(p, p[1:]))

        assert tuple(crf.viterbi(f)) == max(product((0, 1), repeat=n), key=score)
    assert crf.viterbi([]) == []


def good(r):
    return "\n".join(" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(300)) for _ in range(25)) + "." for _ in range(5))


def bad(r):
    return "\n".join(" | ".join(f"w{r.randrange(900)}%%%" for _ in range(15)) for _ in range(6))


def test_held_out_accuracy_and_kept_columns(spark):
    r = random.Random(4)
    docs = [(k, good(r) if k % 3 else bad(r), "own", k % 2 == 0) for k in range(120)] + [(None, None, None, None), (500, "", "own", None), (7, good(r), "twice", None)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(60)] + [(3, None, 1), (None, 1, 0)]
    d, y = spark.createDataFrame(docs, COLS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.assess(d, y).collect()
    assert len(got) == len(docs)
    assert all(x.kept == bool(x.doc_id % 3) for x in got if x.doc_id is not None and 60 <= x.doc_id < 120)
    kept = Q.keep_documents(d, y)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {k for k in range(120) if k % 3}
    assert Q.assess(d.limit(0), y).count() == 0
    untrained = Q.assess(d, y.limit(0)).collect()
    assert all(x.kept == (not x.base_failed) for x in untrained)


def test_lines_of_mixed_documents():
    """Trained on labels of documents only, the chain marks the lines of documents that hold both kinds."""
    r = random.Random(9)
    docs, labels = [(good if k % 2 else bad)(r) for k in range(80)], [k % 2 for k in range(80)]
    found = [Q.lines_of(d.encode()) for d in docs]
    crf = Q.LineCRF.learn([f for _, f, _ in found], [list(map(len, w)) for w, _, _ in found], labels)
    right = n = 0
    for _ in range(60):
        parts = [(line, y) for y in r.sample([0, 1, 0], 3) for line in (good(r) if y else bad(r)).split("\n")[: r.randrange(1, 5)]]
        text = "\n".join(line for line, _ in parts)
        states = crf.viterbi(Q.lines_of(text.encode())[1])
        right, n = right + sum(s == y for s, (_, y) in zip(states, parts)), n + len(parts)
        share = Q.judge(text, crf)[7]
        assert states != [y for _, y in parts] or len({y for _, y in parts}) < 2 or 0 < share < 1
    assert right / n > 0.95


def test_constraint_of_the_document_label():
    g = np.random.default_rng(2)
    crf = Q.LineCRF(g.normal(size=(2, len(Q.FEATURES))), g.normal(size=(2, 2)))
    for n in range(1, 9):
        f, words = [[0, *g.integers(1, 20, 2).tolist()] for _ in range(n)], g.integers(1, 30, n).tolist()
        for kind in (True, False):
            states = crf.constrained(f, words, kind)
            assert (2 * sum(w for w, s in zip(words, states) if s) >= sum(words)) == kind
    assert Q.LineCRF.learn([[[0]]], [[1]], [1]).step.tolist() == [[0, 0], [0, 0]] and Q.spliced([[[0]]], [1]) == ([], [])
