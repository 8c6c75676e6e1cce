import math

import numpy as np

from keystrata.llm import langid as G


def test_accuracy_on_given_tables(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    got = G.languages_of(docs, pages).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    marked = {r.page_id: r.declared for r in G.page_rows(pages).collect()}
    by_doc = [r.lang == truth[r.doc_id] for r in got if r.doc_id is not None]
    by_page = [r.lang == marked[r.page_id] for r in got if r.page_id is not None]
    assert len(by_doc) == len(truth) and len(by_page) == len(marked)
    assert np.mean(by_doc) > 0.93 and np.mean(by_page) > 0.93


def test_fusion_against_hand_computation(spark):
    langs = ["de", "en"]
    rows = [(1, "a.x.com", "de", None, [-1.0, -2.0]), (2, "a.x.com", "en", "en", [-3.0, -1.0]), (3, "b.x.com", None, "zz", [0.0, 0.0]), (4, None, "de", "de", [-5.0, -4.9]), (4, None, "de", "de", [-5.0, -4.9])]
    got = {r.doc_id: r for r in G.fuse(spark.createDataFrame(rows, "doc_id long, host string, declared string, suffix string, ll array<double>"), langs, ["doc_id"]).collect()}
    clean = lambda v: "none" if v is None else v if v in langs else "other"
    data = [(i, h or "", clean(d), clean(s), [x * G.TEXT_WEIGHT for x in ll]) for i, h, d, s, ll in rows]
    votes = [0 if x[4][0] >= x[4][1] else 1 for x in data]
    count = lambda f: [sum(1.0 for x, v in zip(data, votes) if v == k and f(x)) for k in (0, 1)]
    corpus = [(c + 1) / (len(data) + 2) for c in count(lambda x: True)]
    smooth = lambda c, above: [(c[k] + G.SMOOTH * above[k]) / (sum(c) + G.SMOOTH) for k in (0, 1)]
    for (i, h, d, s, ll), v in zip(data, votes):
        top = smooth(count(lambda x: x[1].split(".")[-1] == h.split(".")[-1]), corpus)
        dom = smooth(count(lambda x: x[1].split(".")[-2:] == h.split(".")[-2:]), top)
        own = count(lambda x: x[1] == h)
        own[v] -= 1
        prior = smooth(own, dom)
        total = []
        for k in (0, 1):
            seen = lambda c, val: math.log((count(lambda x: x[c] == val)[k] + 0.5) / (count(lambda x: True)[k] + 0.5 * 4))
            total.append(ll[k] + seen(2, d) + seen(3, s) + math.log(prior[k]))
        top_score = max(total)
        p = [math.exp(t - top_score) for t in total]
        assert got[i].lang == langs[total.index(top_score)]
        assert np.allclose(got[i].posterior, [x / sum(p) for x in p])


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", "s", 1), (1, "", "en", "s", 1), (2, "the word and more", "en", "s", 2)], "doc_id long, text string, lang string, source string, host int")
    pages = spark.createDataFrame([(1, None, None), (None, "not a url", "<p>x"), (3, "http://a.de/x", "<html lang=de>")], "page_id long, url string, html string")
    got = G.languages_of(docs, pages).collect()
    assert len(got) == 7 and all(r.lang == "en" for r in got)
    assert G.languages_of(docs.limit(0), pages.limit(0)).count() == 0
    assert all(r.lang is None for r in G.languages_of(docs.limit(0), pages).collect())


def test_more_than_64_languages(spark):
    langs = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(80)]
    say = lambda k: " ".join(f"{langs[k]}{chr(97 + j)}{langs[79 - k]}" for j in range(20))
    docs = [(k * 3 + j, say(k), x, f"s{k}", 1) for k, x in enumerate(langs) for j in range(3)]
    pages = [(k, f"http://host{k}.org/{x}/", f"<html lang={x}><p>{say(k)}") for k, x in enumerate(langs)]
    got = G.languages_of(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, host int"), spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 320
    assert all(r.lang == langs[r.page_id if r.doc_id is None else r.doc_id // 3] for r in got)


def test_held_out_documents(spark, sf):
    """Models of one half of the documents say the language of the other half from the text alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    languages, model = G.train(docs.filter("doc_id % 2 = 0"))
    held = [(r.text, r.lang) for r in docs.filter("doc_id % 2 = 1").collect() if len(r.text) > 40]
    said = [languages[int(np.argmax(model[G.trigrams(t)].sum(axis=0)))] for t, _ in held]
    assert np.mean([a == b for a, (_, b) in zip(said, held)]) > 0.97


def test_other_evidence_decides_where_the_text_is_silent(spark):
    say = {"de": "der die und ist nicht ein zu das", "en": "the and of is not one to that"}
    docs = [(k, " ".join(np.roll(say[x].split(), k)), x, "s", 1) for k in range(40) for x in say]
    pages = [(k, f"http://h{k % 4}.org/{x}/", f"<html lang={x}><p>{say[x]}") for k in range(30) for x in say]
    pages += [(100, "http://new.net/a", "<html lang=de><p>123"), (101, "http://other.net/de/b", "<p>123"), (102, "http://h.org/en/", "<html lang=en><p>!"), (103, "http://third.edu/a", "<html lang=de><p>the")]
    got = G.languages_of(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, host int"), spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    fused = {r.page_id: (r.lang, r.text_lang) for r in got if r.page_id is not None}
    assert [fused[k][0] for k in (100, 101, 102)] == ["de", "de", "en"] and fused[100][0] == fused[101][0] != "en"
    assert any(lang != text for lang, text in fused.values())


def test_documents_say_nothing_of_pages(spark):
    """However many documents there are, the tables of markup and suffix are those of the pages."""
    pages = [(k, "h", "de" if k % 2 else "en", None, [0.0, -9.0] if k % 2 else [-9.0, 0.0], False) for k in range(20)] + [(99, "i", None, None, [-1.0, -1.2], False)]
    docs = [(1000 + k, f"d{k}", None, None, [0.0, -9.0], True) for k in range(200)]
    kinds = "id long, host string, declared string, suffix string, ll array<double>, silent boolean"
    a = {r.id: r.posterior for r in G.fuse(spark.createDataFrame(pages + docs[:1], kinds), ["de", "en"], ["id"]).collect()}
    b = {r.id: r.posterior for r in G.fuse(spark.createDataFrame(pages + docs, kinds), ["de", "en"], ["id"]).collect()}
    odds = lambda p: p[0] / p[1]
    assert odds(b[99]) / odds(a[99]) < 25  # the corpus prior moves by 18; were documents in the tables, it would be by hundreds
    assert len(b) == 221


def test_sample_is_bounded_and_blind_to_copies(spark, monkeypatch):
    monkeypatch.setattr(G, "SAMPLE_PER_LANGUAGE", 5)
    docs = [(k, f"abc{k:03d}", "en") for k in range(40)] + [(7, "abc007", "en")] * 50
    languages, model = G.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts = np.exp(model[:, 0]) * (0.5 * G.BUCKETS + 5 * 4)  # five texts of four trigrams
    assert languages == ["en"] and abs((counts - 0.5).sum() - 20) < 1e-6


def test_markup_in_one_pass():
    import re
    import time

    old = re.compile(r"<script\b.*?</script\b[^>]*>|<style\b.*?</style\b[^>]*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    r = np.random.default_rng(3)
    bits = ["<p>", "text", "<!--", "-->", "<script>", "</script>", "<STYLE a=b>", "</style>", "<", ">", "é"]
    for _ in range(3000):
        page = " ".join(bits[k] for k in r.integers(0, len(bits), r.integers(0, 12)))
        assert G.visible(page).split() == old.sub(" ", page).split(), page
    began = time.time()
    G.visible("<!--" * 100_000), G.visible("<" * 300_000), G.visible("<script>" * 50_000)
    assert time.time() - began < 5
