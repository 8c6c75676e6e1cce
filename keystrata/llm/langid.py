"""Language identification by Bayesian fusion of four kinds of evidence.

For every row the log posterior of a language is the sum of
- the text likelihood: hashed byte trigrams under a smoothed model per language,
  tempered by ``TEXT_WEIGHT``, as trigrams of a text are far from independent;
- the declared markup language (the ``lang`` attribute of a page) and the
  address suffix (a language code in the path, or a country domain), each under
  a confusion table estimated by grouped counts over all rows that can declare
  one (pages; a document declares nothing, so neither table speaks of it);
- the host prior, smoothed hierarchically: the host's counts are shrunk to its
  domain's, these to the top-level domain's, these to the corpus's, all by
  grouped aggregation of the first-pass decisions. A row's own vote is taken
  out of its host's counts.

The text models are fitted on a bounded sample, at most ``SAMPLE_PER_LANGUAGE``
documents of each declared language, however many languages there are; all else
covers all rows. A model takes 256 KB a language in each worker.

Edge cases: a null or empty text has flat likelihoods, so the other evidence
decides, or the corpus prior alone; a null host, markup or suffix is its own
value "none"; ties go to the alphabetically first language; repeated rows stay;
an empty table gives an empty result; without a labelled document the language
is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, lean, skew_join

SAMPLE_PER_LANGUAGE = 500
BUCKETS = 1 << 15
TEXT_WEIGHT = 0.3
SMOOTH = 5.0

_RAW = re.compile(r"<(script|style)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style")}


def visible(page: str) -> str:
    """A page without comments, scripts, styles and tags; one pass, as an end that is nowhere ahead isn't looked for again."""
    out, at, n, gone = [], 0, len(page), set()
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        raw = _RAW.match(page, lt)
        ends = ["comment"] if page.startswith("<!--", lt) else [raw[1].lower()] if raw else []
        for kind in [*ends, "tag"]:
            if kind in gone:
                continue
            if kind in _ENDS:
                m = _ENDS[kind].search(page, lt)
                end = m.end() if m else -1
            else:
                mark = "-->" if kind == "comment" else ">"
                end = page.find(mark, lt)
                end = end + len(mark) if end >= 0 else -1
            if end >= 0:
                at = end
                break
            gone.add(kind)
        else:  # no end of any kind: the rest is text
            out.append(page[lt:])
            return " ".join(out)
    out.append(page[at:])
    return " ".join(out)


def trigrams(text: str | None) -> np.ndarray:
    """Hash buckets of the byte trigrams of the lower-cased text."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    w = b.astype(np.uint32)
    return (((w[:-2] * np.uint32(0x9E3779B1)) ^ (w[1:-1] * np.uint32(0x85EBCA6B)) ^ (w[2:] * np.uint32(0xC2B2AE35))) >> np.uint32(17)).astype(np.uint32)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets, languages) from at most SAMPLE_PER_LANGUAGE documents of each."""
    languages = sorted(r.lang for r in docs.filter("lang is not null").groupBy("lang").count().collect())
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    picked = docs.filter("lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("_o"))
    # the first of 64 parts of each language, then of these: no window holds a language whole, and equal rows have one rank
    part = Window.partitionBy("lang", F.pmod("_o", F.lit(64))).orderBy("_o")
    some = picked.select("lang", "_o").withColumn("_k", F.dense_rank().over(part)).filter(F.col("_k") <= SAMPLE_PER_LANGUAGE).select("lang", "_o").distinct()
    ids = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_o"))).filter(F.col("_k") <= SAMPLE_PER_LANGUAGE).select("lang", "_o")
    chosen = picked.join(F.broadcast(ids), ["lang", "_o"], "left_semi").dropDuplicates(["lang", "_o"])  # at most SAMPLE_PER_LANGUAGE rows a language
    found = chosen.select("lang", "text").mapInArrow(lean(_sample_counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(languages)), 0.5)
    column = {x: k for k, x in enumerate(languages)}
    for lang, bucket, n in zip(found["lang"].to_pylist(), found["bucket"].to_pylist(), found["n"].to_pylist()):
        table[bucket, column[lang]] += n
    return languages, np.log(table / table.sum(axis=0))


def _likelihoods(model, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        n_lang = table.shape[1]
        for b in batches:
            out = np.zeros((b.num_rows, n_lang))
            for k, t in enumerate(b.column("text").to_pylist()):
                grams = trigrams(visible(t) if markup and t else t)
                for at in range(0, len(grams), 1 << 16):
                    out[k] += np.bincount(grams[at : at + (1 << 16)], minlength=BUCKETS) @ table if len(grams) > BUCKETS else table[grams[at : at + (1 << 16)]].sum(axis=0)
            names = [n for n in b.schema.names if n != "text"]
            ll = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n_lang, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [ll], [*names, "ll"])

    return run


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and top-level domain of a host."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def best(scores: Column, languages: list[str]) -> Column:
    """The language of the highest score, the first of equals."""
    return F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, ids: list[str], markup: bool) -> DataFrame:
    """``rows`` (ids, text, host, declared, suffix, silent) to the same with ``ll`` for the text, cut to a checkpoint by the caller."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*ids, "host", "declared", "suffix", "silent"])
    return rows.select(*ids, "host", "declared", "suffix", "silent", "text").mapInArrow(lean(_likelihoods(rows.sparkSession.sparkContext.broadcast(model), markup)), f"{kinds}, ll array<double>")


def fuse(evidence: DataFrame, languages: list[str], ids: list[str]) -> DataFrame:
    """(ids, lang, confidence, text_lang, posterior) from likelihoods and the three other kinds of evidence.

    Rows marked ``silent`` can't declare anything; without that column none is.
    """
    if "silent" not in evidence.columns:
        evidence = evidence.withColumn("silent", F.lit(False))
    n, place = len(languages), {x: k for k, x in enumerate(languages)}
    known = F.array(*[F.lit(x) for x in languages])
    clean = lambda c: F.when(F.col("silent"), "silent").when(F.array_contains(known, F.col(c)), F.col(c)).otherwise(F.when(F.col(c).isNull(), "none").otherwise("other"))
    rows = cut(evidence.select(*ids, F.coalesce("host", F.lit("")).alias("host"), clean("declared").alias("declared"), clean("suffix").alias("suffix"), F.transform("ll", lambda x: x * TEXT_WEIGHT).alias("ll")))
    rows = rows.withColumn("text_lang", best(F.col("ll"), languages))
    total = rows.count()
    per_host = cut(rows.groupBy("host", "text_lang").agg(F.count(F.lit(1)).cast("double").alias("n")))
    domain, top = host_levels(F.col("host"))
    cells = per_host.withColumns({"domain": domain, "top": top})

    def votes(level: str, name: str) -> DataFrame:
        """One row per value of ``level`` with the votes for each language, in their order."""
        seen = cells.groupBy(level, "text_lang").agg(F.sum("n").alias("n")).groupBy(level).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias("m"))
        return seen.select(level, F.transform(known, lambda x: F.coalesce(F.element_at(F.col("m"), x), F.lit(0.0))).alias(name))

    def table(column: str) -> DataFrame:
        """log P(value | language) for each value: (languages + 3) rows."""
        values = {v: k for k, v in enumerate([*languages, "none", "other"])}
        count = np.full((len(values), n), 0.5)
        for value, lang, m in rows.filter(F.col(column) != "silent").groupBy(column, "text_lang").count().collect():
            count[values[value], place[lang]] += m
        logs = np.log(count / count.sum(axis=0))
        kind = f"array<struct<{column} string, log_{column} array<double>>>"
        lines = json.dumps([{column: v, f"log_{column}": logs[k].tolist()} for v, k in values.items()] + [{column: "silent", f"log_{column}": [0.0] * n}])
        return F.broadcast(rows.sparkSession.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(lines), kind))))

    overall = dict.fromkeys(languages, 0.0) | {r.text_lang: r.n for r in per_host.groupBy("text_lang").agg(F.sum("n").alias("n")).collect()}
    corpus = F.array(*[F.lit((overall[x] + 1) / (total + n)) for x in languages])
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    above = lambda a, p: F.zip_with(F.col(a), p, lambda x, y: x + SMOOTH * y)
    shrunk = lambda counts, p, name: F.transform(above(counts, p), lambda x: x / (F.col(f"{name}_n") + SMOOTH))
    tops = votes("top", "top_votes").withColumn("top_n", sum_of("top_votes")).select("top", shrunk("top_votes", corpus, "top").alias("pt"))
    domains = votes("domain", "domain_votes").withColumns({"domain_n": sum_of("domain_votes"), "top": F.substring_index("domain", ".", -1)})
    domains = domains.join(tops, "top").select("domain", shrunk("domain_votes", F.col("pt"), "domain").alias("above"))
    hosts = votes("host", "votes").withColumns({"rows": sum_of("votes").cast("long"), "domain": domain})
    priors = hosts.join(domains, "domain").select("host", "rows", "votes", "above")
    joined = skew_join(rows, priors, "host", "rows", total).join(table("declared"), "declared").join(table("suffix"), "suffix")
    own = F.transform(known, lambda x: (F.col("text_lang") == x).cast("double"))
    prior = F.zip_with(F.zip_with("votes", own, lambda v, o: v - o), "above", lambda v, a: F.log((v + SMOOTH * a) / (F.col("rows") - 1 + SMOOTH)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(add(F.col("ll"), F.col("log_declared")), F.col("log_suffix")), prior)
    fused = joined.withColumn("score", score).withColumn("raw", F.transform("score", lambda s: F.exp(s - F.array_max("score"))))
    whole = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return fused.select(*ids, best(F.col("score"), languages).alias("lang"), (F.array_max("raw") / whole).alias("confidence"), "text_lang", F.transform("raw", lambda x: x / whole).alias("posterior"))


_COUNTRIES = {"at": "de", "ch": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "mx": "es", "ar": "es", "cl": "es", "be": "fr", "lu": "fr", "br": "pt", "jp": "ja", "cn": "zh", "kr": "ko"}


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages with host, declared markup language and address suffix."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", 1))
    top = F.substring_index(host, ".", -1)
    country = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _COUNTRIES.items() for x in kv]), top), F.when(F.length(top) == 2, top))
    lang = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return pages.withColumns({"host": F.nullif(host, F.lit("")), "suffix": F.coalesce(F.nullif(path, F.lit("")), country), "declared": F.nullif(lang, F.lit("")), "text": F.col("html")})


def languages_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document and page: doc_id or page_id, lang, confidence, text_lang.

    A document's host is its source; it declares nothing and has no address. Its
    ``lang`` column only labels the bounded training sample.
    """
    languages, model = train(docs)
    ids = ["doc_id", "page_id"]
    kinds = {c: df.schema[c].dataType for df, c in ((docs, "doc_id"), (pages, "page_id"))}
    none = lambda t: F.lit(None).cast(t)
    if not languages:
        both = docs.select("doc_id", none(kinds["page_id"]).alias("page_id")).unionByName(pages.select(none(kinds["doc_id"]).alias("doc_id"), "page_id"))
        return both.select(*ids, none("string").alias("lang"), none("double").alias("confidence"), none("string").alias("text_lang"))
    d = docs.select("doc_id", none(kinds["page_id"]).alias("page_id"), "text", F.concat(F.lit("source:"), F.col("source")).alias("host"), none("string").alias("declared"), none("string").alias("suffix"), F.lit(True).alias("silent"))
    p = page_rows(pages).select(none(kinds["doc_id"]).alias("doc_id"), "page_id", "text", "host", "declared", "suffix", F.lit(False).alias("silent"))
    evidence = identify(d, languages, model, ids, False).unionByName(identify(p, languages, model, ids, True))
    return fuse(evidence, languages, ids).drop("posterior")
