import hashlib
import random
import re

from keystrata.llm import pii as P
from keystrata.llm import pii_model as M

COLS = "doc_id long, text string, _t string, spans int, n_chars long"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text, out = text or "", []
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, (p, ok) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m.group())]
    return sorted(out)


def texts():
    r = random.Random(3)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "0255.00.1.9", "4111 1111 1111 1111", "4111111111111111", "79927398713", "+1 (017) 555-7713", "+49", " ", ".", "-", "é", "🙂", "12", "_", "%", "b.c_d@e.f-g.h", "(", ")", "\n", "0", "1.2.3.", "+", "000", "1.2.3.4.5.6.7.8"]
    out = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(900)]
    return out + [None, "", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "🙂 call 017-555-7713 now", "7" * 4000, "a" * 4000 + "@b" + ".c" * 2000, "1." * 3000, "+1" + "(" * 4000, "a@b.cc " * 2000]


def test_base_spans_against_brute_force(spark):
    docs = [(k, t, "x", 1, 2) for k, t in enumerate(texts())] + [(0, texts()[0], "x", 1, 2)]
    got = P.find(spark.createDataFrame(docs, COLS)).collect()
    assert len(got) == len(docs)
    known = {k: t for k, t, *_ in docs}
    for x in got:
        want = brute(known[x.doc_id])
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(w[1] == k for w in want) for k in range(4)), known[x.doc_id][:200]
        line = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (known[x.doc_id][:200], x.spans)
        assert set(line.split(",")) - {""} <= set(x.spans.split(","))


def test_endless_words(spark):
    long = ["7" * 300_000, "a" * 300_000 + "@b" + ".c" * 50_000, "1." * 20_000, "+1" + "(" * 300_000 + "2345678901"]
    got = {x.doc_id: x for x in P.find(spark.createDataFrame([(k, t, "x", 1, 2) for k, t in enumerate(long)], COLS)).collect()}
    assert [(got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) for k in range(4)] == [(0, 0, 0, 0), (1, 0, 0, 0), (0, 5000, 0, 0), (0, 0, 0, 1)]
    assert got[1].spans.startswith("email:0:400002")


def test_added_spans_and_redaction(spark):
    docs = [
        (1, "🙂 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end", "own", 1, 0),
        (2, "write to a.b@c.de or call +1 (017) 555-7713, from 10.0.0.1.", "own", 1, 0),
        (3, "nothing withtherreenorinansthing here, 4.0 and 2024", "own", 1, 0),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(docs, COLS)
    spans = {x.doc_id: x.spans for x in P.find(df).collect()}
    assert spans == {1: "secret:11:51", 2: "email:9:17,phone:26:43,ip:50:58", 3: "", None: ""} or spans[1] == "secret:11:51" and spans[3] == ""
    out = P.redact(df)
    assert out.columns == df.columns
    got = {x.doc_id: x for x in out.collect()}
    assert got[1].text == '🙂 token = "[SECRET]" end' and got[1].n_chars == len(got[1].text) and got[1]._t == "own"
    assert got[2].text == "write to [EMAIL] or call [PHONE], from [IP]."
    assert got[3].text == docs[2][1] and got[None].text is None
    assert P.find(df.limit(0)).count() == 0 and P.redact(df.limit(0)).count() == 0


def test_trees_in_sql_agree_with_python(spark):
    from pyspark.sql import functions as F

    trees, limits = M.model()
    cases = [(0, "abc123def456", 'token = "', '"'), (1, "04dbebab91ab85687d33eeaaf9ac699e1188f962", "x ", " "), (2, "123-45-6789", "ssn ", "."), (3, "DE00123456789012345678", "IBAN ", ""), (4, "017 555-7713", "", "")]
    df = spark.createDataFrame(cases, "g int, m string, left string, right string")
    for g, m, left, right in cases:
        row = df.filter(F.col("g") == g).select(F.struct("m", "left", "right").alias("x")).select(F.expr(P._features_sql(g)).alias("f"))
        f = row.first().f
        assert list(f) == M.features(g, m, left, right)
        got = row.select(F.expr(" + ".join(P._tree_sql(t) for t in trees)).alias("s")).first().s
        assert abs(got - M.predict(trees, list(f))) < 1e-9


def test_held_out_accuracy():
    trees, limits = M.model()
    x, y = M.examples(3000, seed=99)
    said = [M.predict(trees, r) >= limits[int(r[0])] for r in x]
    right = sum(bool(s) == bool(t) for s, t in zip(said, y)) / len(y)
    false = sum(s and not t for s, t in zip(said, y)) / max(1, sum(said))
    assert right > 0.9 and false < 0.05


def all_spans(text):
    """Base spans and added ones, candidate by candidate in plain Python."""
    import regex

    text, base = text or "", brute(text)
    trees, limits = M.model()
    found = []
    for g, name in enumerate(M.GENERATORS):
        last, matches = 0, list(regex.compile(P._PATTERNS[name]).finditer(text))
        for m, after in zip(matches, [*matches[1:], None]):
            gap, following = text[last : m.start()], text[m.end() : after.start() if after else len(text)]
            last = m.end()
            score = M.predict(list(trees), M.features(g, m.group(), gap[-24:], following[:1]))
            if score >= limits[g] and not any(s < m.end() and m.start() < e for s, _, e in base):
                found.append((-score, m.start(), P.KINDS.index(M.KIND_OF[g]), m.end()))
    added = []
    for _, s, k, e in sorted(found):
        if not any(s < z and a < e for a, _, z in added):
            added.append((s, k, e))
    return sorted(base + added)


def private_texts():
    r = random.Random(12)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    digits, mixed = "0123456789", "ABCDEFGHabcdefgh0123456789"
    bits = [
        lambda: "token = " + pick(mixed, r.randrange(8, 40)), lambda: "ssn " + pick(digits, 3) + "-" + pick(digits, 2) + "-" + pick(digits, 4), lambda: "IBAN DE" + pick(digits, 20),
        lambda: "tel. (" + pick(digits, 3) + ") " + pick(digits, 3) + "-" + pick(digits, 4), lambda: "a.b@c.de", lambda: pick("abcdefgh", 60) + "9" + pick(mixed, 5), lambda: "-", lambda: pick(digits, 3) + "-" + pick(digits, 3) + "-" + pick(digits, 4),
        lambda: "key='" + pick(mixed, 32) + "'", lambda: "é word", lambda: "10.0.0.1", lambda: "+1 017 555 7713",
    ]
    out = [r.choice([" ", "", "\n"]).join(r.choice(bits)() for _ in range(r.randrange(1, 14))) for _ in range(300)]
    return out + ["secret: " + "x" * 60 + "Q7" + pick(mixed, 20), " ".join(r.choice(bits)() for _ in range(1500))]


def test_all_spans_and_redaction_against_brute_force(spark):
    known = dict(enumerate(private_texts()))
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in known.items()], COLS)
    seen = set()
    for x in P.find(df).collect():
        want = all_spans(known[x.doc_id])
        seen |= {P.KINDS[k] for _, k, _ in want}
        assert x.spans == ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want), known[x.doc_id][:300]
    assert seen == set(P.KINDS) - {"card"} or seen == set(P.KINDS)
    for x in P.redact(df).collect():
        text, out, at = known[x.doc_id], "", 0
        merged = []
        for s, k, e in all_spans(text):
            if merged and s < merged[-1][2]:
                merged[-1] = (*merged[-1][:2], max(e, merged[-1][2]))
            else:
                merged.append((s, k, e))
        for s, k, e in merged:
            out, at = out + text[at:s] + f"[{P.KINDS[k].upper()}]", e
        assert x.text == out + text[at:]


def test_a_megabyte_of_mails_takes_seconds(spark):
    import time

    text = " ".join(f"user{k}@x.de" for k in range(66_000))
    df = spark.createDataFrame([(1, text, "x", 1, 2)], COLS)
    began = time.time()
    assert P.find(df).first().n_email == 66_000 and P.redact(df).first().n_chars == 8 * 66_000 - 1
    assert time.time() - began < 60
