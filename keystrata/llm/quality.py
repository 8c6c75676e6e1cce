"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line with a word becomes a set of binary features. A two-state CRF,
trained here on a bounded sample of labelled documents, is decoded by Viterbi
over the whole text; the share of words in content lines decides retention,
after two fixed rules on length and repetition.

Training: ``SAMPLE_DOCS`` labelled documents with the smallest id hashes and at
most ``SAMPLE_LINES`` lines of each. Labels are of documents, and most documents
are of one kind throughout, so they show no change of state. Changes come from
spliced documents: runs of lines of a good and a bad document in turn, one for
two documents, each line labelled by its source. The labels of the
lines of whole documents are found by expectation-maximisation: they begin with
the label of their document; the chain is fitted; each document is decoded again
under the constraint that content has its share of the words in good documents
and not in bad ones (a price a word on the wrong side, raised until that holds);
and so on for ``ROUNDS`` rounds.
With no labelled document (or only one kind of label) the CRF is neutral and
only the fixed rules decide.

Edge cases: a null or wordless text has no words and fails the length rule;
repeated rows stay; other columns are ignored by ``assess`` and kept by
``keep_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

SAMPLE_DOCS = 2000
SAMPLE_LINES = 64
CONTENT_SHARE = 0.5
ROUNDS = 2
LEAST_WORDS = 50

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_ONLY_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_ONLY_BANGS = bytes(c for c in range(256) if c not in b"!?")
_ONLY_DIGITS = bytes(c for c in range(256) if c not in b"0123456789")
_WITHOUT_BLANKS = BLANKS + bytes(range(0x80, 0xC0))  # blanks and UTF-8 continuation bytes

FEATURES = (
    "bias", "words_1", "words_2_4", "words_5_9", "words_10_19", "words_20", "symbols_some", "symbols_many", "symbols_most", "bangs_some", "bangs_many",
    "digits_many", "upper", "ends_sentence", "few_distinct", "one_distinct", "seen_before", "first", "last", "words_short", "words_long", "starts_upper",
)
FIRST, LAST = FEATURES.index("first"), FEATURES.index("last")


def line_features(line: bytes, words: list[bytes], seen: bool, first: bool, last: bool) -> list[int]:
    """The numbers of the features that hold for one line."""
    n = len(words)
    symbols, bangs = len(line.translate(None, _ONLY_SYMBOLS)), len(line.translate(None, _ONLY_BANGS))
    distinct = len(set(words))
    chars = len(line.translate(None, BLANKS))
    f = [0, 1 if n == 1 else 2 if n < 5 else 3 if n < 10 else 4 if n < 20 else 5]
    if symbols:
        f.append(6 if symbols * 10 < n else 7 if symbols * 2 < n else 8)
    if bangs:
        f.append(9 if bangs * 4 < n else 10)
    if len(line.translate(None, _ONLY_DIGITS)) * 3 > chars:
        f.append(11)
    if line.isupper():
        f.append(12)
    if line.rstrip()[-1:] in b".!?":
        f.append(13)
    if n >= 5 and distinct * 2 < n:
        f.append(14)
    if n >= 5 and distinct * 5 < n:
        f.append(15)
    if seen:
        f.append(16)
    if first:
        f.append(17)
    if last:
        f.append(18)
    if chars < 3 * n:
        f.append(19)
    if chars > 10 * n:
        f.append(20)
    if line[:1].isupper():
        f.append(21)
    return f


def lines_of(text: bytes) -> tuple[list[list[bytes]], list[list[int]], int]:
    """Words and features of each line with a word, and how many repeat an earlier line."""
    raw = [(line, w) for line in text.split(b"\n") if (w := line.split())]
    seen: set[bytes] = set()
    words, features, repeats = [], [], 0
    for k, (line, w) in enumerate(raw):
        again = line in seen
        repeats += again
        seen.add(line)
        words.append(w)
        features.append(line_features(line, w, again, k == 0, k == len(raw) - 1))
    return words, features, repeats


class LineCRF:
    """Two states: 0 boilerplate, 1 content. ``emit`` is (2, features), ``step`` is (2, 2) from, to."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None) -> None:
        self.emit = np.zeros((2, len(FEATURES))) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step
        self._table = [self.emit[0].tolist(), self.emit[1].tolist()]

    def viterbi(self, features: list[list[int]], bonus: list[float] | None = None) -> list[int]:
        """The best state of each line; ties go to content. ``bonus`` is added to the content score of each line."""
        (t00, t01), (t10, t11) = self.step.tolist()
        zero, one = self._table
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(features):
            e0, e1 = sum(map(zero.__getitem__, f)), sum(map(one.__getitem__, f))
            if bonus is not None:
                e1 += bonus[k]
            if k == 0:
                a, b = e0, e1
                continue
            from0, from1 = a + t00 <= b + t10, a + t01 <= b + t11
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
        if not features:
            return []
        state = int(b >= a)
        states = [state]
        for choice in reversed(back):
            state = int(choice[state])
            states.append(state)
        return states[::-1]

    def constrained(self, features: list[list[int]], words: list[int], good: bool, share: float = CONTENT_SHARE) -> list[int]:
        """The best states under which content has its share of the words exactly if the document is good."""
        price, total = 0.0, sum(words)
        for _ in range(40):
            states = self.viterbi(features, [price * w if good else -price * w for w in words])
            if (sum(w for w, s in zip(words, states) if s) >= share * total) == good:
                return states
            price = max(0.01, price * 2)
        return [int(good)] * len(features)

    @classmethod
    def learn(cls, docs: list[list[list[int]]], words: list[list[int]], labels: list[int], share: float = CONTENT_SHARE, rounds: int = ROUNDS) -> LineCRF:
        """Fit on document labels by expectation-maximisation over the labels of their lines."""
        lines = [[y] * len(d) for d, y in zip(docs, labels)]
        mixed, mixed_lines = spliced(docs, labels)
        kinds = [*labels, *(2 for _ in mixed)]
        crf = cls.fit([*docs, *mixed], [*lines, *mixed_lines], kinds)
        for _ in range(rounds - 1):
            found = [crf.constrained(d, w, bool(y), share) for d, w, y in zip(docs, words, labels)]
            if found == lines:
                break
            lines, crf = found, cls.fit([*docs, *mixed], [*found, *mixed_lines], kinds, 40, 0.05, start=crf)
        return crf

    @classmethod
    def fit(cls, docs: list[list[list[int]]], lines: list[list[int]], labels: list[int], rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3, start: LineCRF | None = None) -> LineCRF:
        """Maximise the conditional likelihood of line labels by Adam on exact forward-backward gradients; each kind of document in ``labels`` weighs the same."""
        docs, lines, labels = zip(*((d, s, y) for d, s, y in zip(docs, lines, labels) if d)) if any(docs) else ((), (), ())
        if len(set(labels)) < 2:
            return cls()
        n, most = len(docs), max(map(len, docs))
        real, state = np.zeros((n, most), dtype=bool), np.zeros((n, most), dtype=np.int64)
        for i, d in enumerate(docs):
            real[i, : len(d)], state[i, : len(d)] = True, lines[i]
        x = np.zeros((real.sum(), len(FEATURES)))  # one row for each real line, in order
        for k, f in enumerate(f for d in docs for f in d):
            x[k, f] = 1
        y = np.array(labels)
        weight = n / len(set(labels)) / np.bincount(y)[y]
        theta = np.zeros(2 * len(FEATURES) + 4) if start is None else np.concatenate([start.emit.ravel(), start.step.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = real.sum()
        for r in range(1, rounds + 1):
            emit, step = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
            e = np.zeros((n, most, 2))
            e[real] = x @ emit.T
            ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            ahead[:, 0] = e[:, 0]
            for k in range(1, most):
                ahead[:, k] = np.where(real[:, k, None], np.logaddexp(ahead[:, k - 1, 0, None] + step[0], ahead[:, k - 1, 1, None] + step[1]) + e[:, k], ahead[:, k - 1])
            for k in range(most - 2, -1, -1):
                nxt = behind[:, k + 1] + e[:, k + 1]
                behind[:, k] = np.where(real[:, k + 1, None], np.logaddexp(step[:, 0] + nxt[:, 0, None], step[:, 1] + nxt[:, 1, None]), behind[:, k + 1])
            z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            p = np.exp(ahead + behind - z[:, None, None]) * real[..., None]
            want = np.stack([1 - state, state], 2) * real[..., None]
            gap = (want - p) * weight[:, None, None]
            g_emit = gap[real].T @ x
            g_step = np.zeros((2, 2))
            pairs = real[:, 1:] * weight[:, None]
            for s in (0, 1):
                for t in (0, 1):
                    joint = np.exp(ahead[:, :-1, s] + step[s, t] + e[:, 1:, t] + behind[:, 1:, t] - z[:, None]) * pairs
                    g_step[s, t] = (pairs * ((state[:, :-1] == s) & (state[:, 1:] == t))).sum() - joint.sum()
            g = np.concatenate([g_emit.ravel(), g_step.ravel()]) / total - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        return cls(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def spliced(docs: list[list[list[int]]], labels: list[int], mean_run: int = 3) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Documents of runs of lines of a good and a bad one in turn, and the labels of their lines."""
    r = random.Random(len(docs))
    good, bad = ([d for d, y in zip(docs, labels) if d and bool(y) == kind] for kind in (True, False))
    out, lines = [], []
    for _ in range(len(docs) // 2 if good and bad else 0):
        sources, at, state = (r.choice(bad), r.choice(good)), [0, 0], r.randrange(2)
        doc, own = [], []
        while len(doc) < SAMPLE_LINES and (at[0] < len(sources[0]) or at[1] < len(sources[1])):
            run = min(1 + int(r.expovariate(1 / mean_run)), len(sources[state]) - at[state])
            doc += [[f for f in line if f not in (FIRST, LAST)] for line in sources[state][at[state] : at[state] + run]]
            own += [state] * run
            at[state] += run
            state = 1 - state
        doc, own = doc[:SAMPLE_LINES], own[:SAMPLE_LINES]
        doc[0], doc[-1] = sorted({*doc[0], FIRST}), sorted({*doc[-1], LAST})
        out.append(doc)
        lines.append(own)
    return out, lines


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, until, n = Counter(windows), 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            n += k + 3 - max(k, until)
            until = k + 3
    return n


def judge(text: str | None, crf: LineCRF, share: float = CONTENT_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    per_line, features, dup = lines_of(raw)
    repeated = repeat_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > 50 * n
    states = crf.viterbi(features)
    content = sum(len(w) for w, s in zip(per_line, states) if s) / n if n else 0.0
    return n, len(raw.translate(None, _WITHOUT_BLANKS)), len(raw.translate(None, _ONLY_SYMBOLS)), dup, repeated, failed, not failed and content >= share, content


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [lines_of((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        features = pa.array([f[:SAMPLE_LINES] for _, f, _ in rows], pa.list_(pa.list_(pa.int32())))
        words = pa.array([list(map(len, w[:SAMPLE_LINES])) for w, _, _ in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("_o"), features, words], ["quality", "o", "features", "words"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> LineCRF:
    """Fit on at most ``sample`` labelled documents; the driver sees feature numbers only, of a bounded size."""
    picked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.withColumn("_o", F.xxhash64("doc_id")).orderBy("_o").limit(sample).withColumnRenamed("doc_id", "_id")
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("quality", "_o", "text")
        .mapInArrow(lean(_sample_features), "quality int, o long, features array<array<int>>, words array<int>").orderBy("o", F.hash("features")).limit(2 * sample).collect()
    )
    return LineCRF.learn([r.features for r in rows], [r.words for r in rows], [int(r.quality) for r in rows])


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _judge(crf: LineCRF, share: float):
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    names = [f.split()[0] for f in VERDICT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t, crf, share) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    return run


def assess(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the counts and the verdict for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_judge(train(docs, labels), share)), f"doc_id {kind}, {VERDICT}")


def keep_documents(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    crf = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t, crf, share)[6] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
