"""Token counts with overlap resynchronisation for huge documents.

Where the tokenizer file is a plain byte-level BPE (checked: vocabulary, ordered
merges, the byte-level pattern, special strings without white space), all texts
are counted by a rank encoder over the same vocabulary, several times as fast as
the library and tested to agree with it. Any other file goes to the library, text
by whole text, as its boundaries are not proven stable here.

A text of up to ``CHUNK`` characters is encoded at once. A longer one is encoded
in chunks that overlap, with offsets, and the counts are spliced at a boundary
that both chunks have and that is proven stable: a position between a character
that is not white space and a blank, or between a letter, a digit and a mark
(not after an apostrophe, which may begin a contraction). No alternative of the
pattern matches past such a place, and matching restarts there whatever came
before, so both sides encode as in the whole text. No place within a special
string counts. If the overlap has no such boundary, or the encodings disagree
about it, the overlap is widened (doubled, to the end of the text if need be),
and the result stays exact. What is held at once is a chunk, or the longest run
of characters of one kind, which the tokenizer itself can't divide.

Edge cases: a null text is empty; repeated rows stay; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

#: How the byte-level pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 13
OVERLAP = 1 << 9
BATCH_CHARS = 1 << 21
LIMIT = 512


#: Characters that every Unicode version calls letters, digits, and neither letters, digits nor white space.
_LETTER, _DIGIT, _MARK = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u0410-\\u044f\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3", "0-9", "!-/:-@\\[-`{-~\\u3001-\\u3003\\uff01\\uff0c"
_STABLE = re.compile(rf"(?<=[^\s])(?= )|(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_MARK}])|(?<=[{_MARK}])(?<!')(?=[{_LETTER}{_DIGIT}])")


def stable_boundaries(text: str, start: int, end: int, special: tuple[str, ...] = ()) -> Iterator[int]:
    """Positions in (start, end) that every encoding of the text has as a boundary, last first."""
    for p in reversed([m.start() for m in _STABLE.finditer(text, start + 1, end)]):
        if not any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in special):
            yield p


def _cut_at(ends: np.ndarray, at: int) -> int | None:
    """How many tokens lie left of byte ``at``, if it is a token boundary."""
    k = int(np.searchsorted(ends, at))
    return 0 if at == 0 else k + 1 if k < len(ends) and ends[k] == at else None


def count_long(text: str, ends_of: Callable[[str], np.ndarray], chunk: int = CHUNK, overlap: int = OVERLAP, special: tuple[str, ...] = ()) -> int:
    """Tokens of one text, chunk by chunk; ``ends_of`` gives where the tokens of a text end, in bytes of its UTF-8."""
    size_of = lambda t: len(t.encode("utf-8", "surrogatepass"))
    total, start = 0, 0  # what is left of `start` is counted
    size, shared = chunk, overlap
    while len(text) - start > size:
        end = start + size
        left = ends_of(text[start:end])
        right_start = max(start, end - shared)
        right = ends_of(text[right_start : min(len(text), end + shared)])
        for p in stable_boundaries(text, right_start, end - 1, special):
            mine, theirs = _cut_at(left, size_of(text[start:p])), _cut_at(right, size_of(text[right_start:p]))
            if mine is not None and theirs is not None:
                total, start, size, shared = total + mine, p, chunk, overlap
                break
        else:  # no common boundary: look at more
            shared *= 2
            size = max(size, 2 * shared)
    return total + len(ends_of(text[start:]))


class RankEncoder:
    """Token counts and token ends by merge ranks."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        import tiktoken

        self._core, self._allowed, self.special = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe, set(special), tuple(special)
        self._sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, k in [*ranks.items(), *((s.encode(), k) for s, k in special.items())]:
            self._sizes[k] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self._core.encode_to_tiktoken_buffer(text, self._allowed), dtype=np.uint32)

    def ends(self, text: str) -> np.ndarray:
        return np.cumsum(self._sizes[self._ids(text)])

    def count(self, text: str) -> int:
        return len(self._ids(text)) if len(text) <= CHUNK else count_long(text, self.ends, special=self.special)


def rank_encoder(path: str) -> RankEncoder | None:
    """The encoder of a tokenizer file, or None where the file asks for more than a plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], spec.get("added_tokens") or []
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or spec.get("normalizer") or odd or {k: (spec.get("pre_tokenizer") or {}).get(k) for k in plain} != plain:
        return None
    if any(t.get(k) for t in special for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    names = {t["content"]: t["id"] for t in special}
    if any(not n or any(c.isspace() for c in n) for n in names):
        return None
    try:
        ranks = {bytes(byte_of[c] for c in k): i for k, i in model["vocab"].items() if k not in names}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    except KeyError:
        return None
    if made != sorted(made) or len(ranks) != 256 + len(made) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return RankEncoder(ranks, names)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        fast = rank_encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            if fast is not None:
                counts = [fast.count(t) for t in texts]
            else:
                counts, some, chars = [0] * len(texts), [], 0
                for k, t in enumerate(texts):
                    some.append(k)
                    chars += len(t)
                    if chars > BATCH_CHARS or k == len(texts) - 1:
                        for at, e in zip(some, tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)):
                            counts[at] = len(e)
                        some, chars = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; ``path`` is a tokenizers file all executors see."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_count(path)), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
