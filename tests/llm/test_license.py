import random
import re

from keystrata.llm import license as L

ODD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(ODD, low)
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_against_brute_force():
    r, m = random.Random(1), L.automaton()
    bits = ["CC", "by", "cc by", "-", " ", "\n", "General", "PUBLIC", "license", "All", "rights", "reserved.", "é", "日本", "x1", "_", "{", "cc-by", " ", " ", ", "]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        assert L.scan(t, m)[:5] == brute(t), t
    assert L.scan(None, m) == (0, 0, None, None, "", "", 0.0)
    assert L.scan("cc by " * 30000, m)[:4] == (60000, 30000, 0, 59998)


def test_expressions():
    post = L.shunting_yard("MIT OR Apache-2.0 AND (GPL-2.0-only WITH Classpath-exception-2.0)")
    assert post == (["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and", "or"], True)
    assert L.evaluate(post[0]) == (["apache-2.0", "gpl-2.0-only-with-classpath-exception-2.0", "mit"], True)
    assert L.evaluate(L.shunting_yard("GPL-3.0-only AND MIT")[0]) == (["gpl-3.0-only", "mit"], False)
    for bad in ("", "(", ")", "AND", "MIT AND", "(MIT", "MIT)", "WITH x", "() OR MIT"):
        assert L.shunting_yard(bad)[1] is False
        L.evaluate(L.shunting_yard(bad)[0])
    assert L.shunting_yard("(" * 5000 + "MIT" + ")" * 5000) == (["MIT"], True)


def test_labels_and_rows(spark):
    docs = [(1, "// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode", "x"), (2, "Licensed under CC BY-NC 4.0.", "x"), (None, None, "x"), (2, "", "x"), (2, "", "x"), (3, "plain", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, labels string")
    got = {(r.doc_id, r.labels, r.base_labels) for r in L.licenses(df).collect()}
    assert got == {(1, "gpl-2.0-only,mit,spdx,spdx-permissive", ""), (2, "cc-by,cc-by-nc,cc-by-nc-4.0,licensed", "cc-by"), (None, "", ""), (2, "", ""), (3, "", "")}
    assert L.licenses(df).count() == 6 and L.licenses(df.limit(0)).count() == 0
    assert all(0 <= r.score <= 1 for r in L.licenses(df).collect())
