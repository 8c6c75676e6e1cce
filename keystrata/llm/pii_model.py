"""Boosted trees over span candidates, trained on generated examples.

No table labels personal data beyond the base kinds, so candidates for the
added kinds are generated with their context: real-looking values among the
numbers, codes and long words that resemble them. Trees of depth two are fitted
by gradient boosting on the logistic loss; a held-out part sets, for each
generator, the lowest score at which precision stays at ``PRECISION``.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

GENERATORS = ("assigned", "token", "national_id", "iban", "local_phone")
#: The kind of span that each generator proposes.
KIND_OF = ("secret", "secret", "national_id", "iban", "local_phone")
FEATURES = ("gen", "n", "digits", "upper", "lower", "marks", "keyword", "quoted", "hexes", "switches")
KEYWORDS = r"(?:token|secret|passw|pwd|api|key|auth|bearer|ssn|social|iban|account|konto|bank|phone|tel|call|fax|mobil|contact)"
PRECISION = 0.98
ROUNDS = 40
RATE = 0.3


def features(gen: int, text: str, left: str, right: str) -> list[int]:
    """The twin of the SQL features, for training and tests."""
    return [
        gen, len(text), len(re.sub("[^0-9]", "", text)), len(re.sub("[^A-Z]", "", text)), len(re.sub("[^a-z]", "", text)), len(re.sub("[A-Za-z0-9]", "", text)),
        int(re.search(KEYWORDS, re.sub("[A-Z]", lambda m: m.group().lower(), left)) is not None), int(left[-1:] in ('"', "'") and left[-1:] != "" and right[:1] == left[-1:]),
        len(re.sub("[^0-9a-fA-F]", "", text)), len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", text)),
    ]


def examples(n: int = 6000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates: features and whether each is personal or secret."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    digits, hexes, mixed, letters = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(letters, r.randrange(2, 9))
    prose = lambda: " ".join(word() for _ in range(3)) + " "
    rows, labels = [], []
    for _ in range(n):
        gen, real = r.randrange(5), r.random() < 0.5
        left, right = prose(), r.choice([" ", ".", ",", "\n"])
        if gen in (0, 1):
            q = r.choice(['"', '"', "'", ""])
            key = r.choice(["token = ", "api_key=", "secret: ", "password = ", "auth: ", "TOKEN = ", "access key: "])
            if real:
                text = r.choice([pick(hexes, r.choice([32, 40, 64])), pick(mixed, r.randrange(20, 50)), pick(hexes, 40).upper(), pick(mixed, r.randrange(16, 24)) + "_" + pick(mixed, 9)])
                if gen == 0 or r.random() < 0.8:
                    left, right = left + key + q, q or right
            elif gen == 0:
                text = r.choice([pick(letters, r.randrange(8, 16)), pick(letters, 6) + "-" + pick(letters, 5), pick(digits, 8), pick(letters, 9) + "1"])
                left, right = left + key + r.choice(["", '"']), right
            else:
                text = r.choice([pick(letters, r.randrange(18, 30)) + pick(digits, 1), pick(digits, r.randrange(20, 30)), "/".join(word() for _ in range(5)) + "/2" + pick(digits, 3) + "-x", "-".join(word() for _ in range(5)) + "-2024", "_" * 20 + "1", "-" * 30 + "2"])
        elif gen == 2:
            text = pick(digits, 3) + "-" + pick(digits, 2) + "-" + pick(digits, 4)
            left += r.choice(["ssn ", "SSN: ", "social security number "]) if real else r.choice(["part ", "no. ", "", "version "])
        elif gen == 3:
            if real:
                text = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + pick(digits, r.randrange(16, 24))
                left += r.choice(["IBAN ", "account: ", "bank ", "Konto ", "iban: "])
            else:
                text = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + pick(digits, 2) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randrange(11, 20))
                left += r.choice(["", "model ", "code "])
        elif real:
            text = r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {}-{}"]).format(pick(digits, 3), pick(digits, 3), pick(digits, 4))
            left += r.choice(["phone ", "tel. ", "call ", "fax: ", "mobile ", "contact "])
        else:
            text = r.choice(["{}-{}-{}", "{}.{}.{}", "{}{}-{}", "{} {} {}"]).format(pick(digits, 3), pick(digits, 3), pick(digits, 4))
            left += r.choice(["", "order ", "isbn ", "no. ", "id "])
        rows.append(features(gen, text, left[-24:], right))
        labels.append(int(real))
    return np.array(rows, dtype=float), np.array(labels, dtype=float)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    best, found = 1e-9, None
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 12)).round(2)):
            left = rows & (x[:, f] <= t)
            right = rows & ~(x[:, f] <= t)
            if left.sum() < 10 or right.sum() < 10:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total
            if gain > best:
                best, found = gain, (f, float(t))
    return found


def predict(trees: list[tuple], row: list[float]) -> float:
    total = 0.0
    for tree in trees:
        while isinstance(tree, tuple):
            f, t, low, high = tree
            tree = low if row[f] <= t else high
        total += tree
    return total


@lru_cache(maxsize=1)
def model() -> tuple[tuple, tuple[float, ...]]:
    """Trees (feature, threshold, low, high | leaf value) and one score threshold for each generator."""
    x, y = examples()
    held = np.arange(len(y)) % 3 == 0
    fit, score, trees = ~held, np.zeros(len(y)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        found = _split(x, g, h, rows) if depth else None
        if found is None:
            return float(RATE * g[rows].sum() / (h[rows].sum() + 1))
        f, t = found
        return (f, t, grow(rows & (x[:, f] <= t), g, h, depth - 1), grow(rows & ~(x[:, f] <= t), g, h, depth - 1))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = grow(fit, y - p, p * (1 - p), 2)
        trees.append(tree)
        score += np.array([predict([tree], r) for r in x])
    limits = []
    for gen in range(len(GENERATORS)):
        own = held & (x[:, 0] == gen)
        s, hit = score[own], y[own]
        precise = [t for t in np.unique(s) if hit[s >= t].mean() >= PRECISION]
        limits.append(max(0.0, float(min(precise))) if precise else float("inf"))  # never below even odds
    return tuple(trees), tuple(limits)
