"""Personal data: base spans by pattern, further spans by candidate gradient boosting.

Native: SQL functions only. A pattern's places come from splitting the text by
it (the gaps) and extracting it (the matches): both use the same leftmost
search, so their lengths add up to code-point offsets. Patterns are written so
that no start is tried twice and no repetition backtracks, which keeps them
linear on texts of one endless word. Sums and maxima along an array are scans
by doubling steps, so n spans cost n log n.

Base kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone
(9 to 15 digits); matches that fail are dropped and not tried again. Added
kinds: generators of high recall propose overlapping candidates; boosted trees
(``pii_model``), written as CASE expressions, score format and context; a
calibrated threshold per generator accepts. None that touches a base span is
added; of the others the best score is taken first (ties: the first start), then
the best that overlaps none taken. The keyword feature looks at the 24 code
points before a candidate, as in training.

Edge cases: a null text is empty for ``find`` and stays null in ``redact``;
repeated rows stay; clashing names are taken care of by prefixes; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pii_model
from ._common import safe_text

BASE = ("email", "ip", "card", "phone")
BLOCK = 4096
KINDS = (*BASE, "secret", "national_id", "iban", "local_phone")

_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "assigned": r"(?<=(?:key|KEY|token|TOKEN|secret|SECRET|password|passwd|pwd|auth)[ ]{0,2}[=:][ ]{0,2}[\"']?)(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}+",
    "token": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_DIGIT = r"[0-9]"
#: Cheap tests that a match needs.
_GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "assigned": lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), "token": lambda t: t.rlike(_DIGIT), "national_id": lambda t: t.rlike(r"[0-9]-[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), "local_phone": lambda t: t.rlike(r"[0-9][\x20.-][0-9]{4}"),
}
_VALID = {
    "email": "true",
    "ip": r"m rlike r'^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)(?:\.|$)){4}$'",
    "card": "length(d) between 12 and 19 and aggregate(sequence(1, length(d)), 0, (s, i) -> s + case when i % 2 = 1 then int(substr(d, -i, 1)) else element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substr(d, -i, 1)) + 1) end) % 10 = 0",
    "phone": "length(d) between 9 and 15",
}


def places(text: Column, name: str) -> tuple[Column, Column]:
    """Matches of a pattern and the gaps around them (both empty where its guard fails)."""
    none = F.array().cast("array<string>")
    found = F.when(_GUARDS[name](text), F.regexp_extract_all(text, F.lit(_PATTERNS[name]), F.lit(0))).otherwise(none)
    return found, F.when(F.size(found) > 0, F.split(text, _PATTERNS[name], -1)).otherwise(none)


_SPAN = "array<struct<start: int, m: string, left: string, right: string>>"


_NO_INTS = "cast(array() as array<int>)"


def _scan(array: str, op: str) -> str:
    """SQL: the running ``op`` (of x and y) along the ints of a column, in log2(size) passes."""
    step = "shiftleft(1, k)"
    return f"aggregate(sequence(0, int(ceil(log2(greatest(1, size({array})))))), {array}, (a, k) -> transform(a, (x, i) -> if(i >= {step}, {op.replace('y', f'a[i - {step}]')}, x)))"


def _let(body: str, *columns: str) -> str:
    """SQL: ``body`` with the columns as fields of v.

    An array that a lambda looks things up in must be bound so: the optimizer may
    put the expression of a column in its place, and a lambda would evaluate that
    for each element.
    """
    fields = ", ".join(f"'{c}', {c}" for c in columns)
    return f"element_at(transform(array(named_struct({fields})), v -> {re.sub('(?<![A-Za-z_.])(' + '|'.join(columns) + ')(?![A-Za-z_0-9])', r'v.\1', body)}), 1)"


def _offsets(name: str) -> str:
    """SQL: matches with their start and context, from columns _m_, _g_ and the running lengths _p_."""
    g, m, p = f"_g_{name}", f"_m_{name}", f"_p_{name}"
    return _let(f"transform({m}, (m, i) -> named_struct('start', {p}[i] - length(m), 'm', m, 'left', right({g}[i], 24), 'right', left({g}[i + 1], 1)))", m, g, p)


def _heads(spans: str, ends: str) -> str:
    """SQL: where a span begins that touches none before it; ``ends`` is the running maximum of the ends."""
    return _let(f"if(size({spans}) = 0, {_NO_INTS}, filter(sequence(0, size({spans}) - 1), i -> i = 0 or {spans}[i].start >= {ends}[greatest(i, 1) - 1]))", spans, ends)


def _after(heads: str, spans: str) -> str:
    """SQL: the end (exclusive) of the group that begins at heads[k]."""
    return f"if(k + 1 < size({heads}), {heads}[least(k + 1, size({heads}) - 1)], size({spans}))"


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, t, low, high = tree
    return f"case when f.{pii_model.FEATURES[f]} <= {t!r} then {_tree_sql(low)} else {_tree_sql(high)} end"


def _features_sql(gen: int) -> str:
    return (
        f"named_struct('gen', {gen}, 'n', length(x.m), 'digits', length(regexp_replace(x.m, '[^0-9]', '')), 'upper', length(regexp_replace(x.m, '[^A-Z]', '')),"
        " 'lower', length(regexp_replace(x.m, '[^a-z]', '')), 'marks', length(regexp_replace(x.m, '[A-Za-z0-9]', '')),"
        f" 'keyword', int(lower(x.left) rlike '{pii_model.KEYWORDS}'), 'quoted', int(right(x.left, 1) in ('\"', '\\'') and x.right = right(x.left, 1)),"
        " 'hexes', length(regexp_replace(x.m, '[^0-9a-fA-F]', '')), 'switches', size(regexp_extract_all(x.m, '[0-9][A-Za-z]|[A-Za-z][0-9]', 0)))"
    )


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with _base and _added: arrays of (start, kind, end), each sorted."""
    names = [*BASE, *pii_model.GENERATORS]
    docs = docs.withColumn("_t", text)
    docs = docs.withColumns({f"_m_{n}": places(F.col("_t"), n)[0] for n in names})
    docs = docs.withColumns({f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split("_t", _PATTERNS[n], -1)).otherwise(F.array().cast("array<string>")) for n in names})
    docs = docs.withColumns({f"_l_{n}": F.expr(f"zip_with(slice(_g_{n}, 1, size(_m_{n})), _m_{n}, (g, m) -> length(g) + length(m))") for n in names})
    docs = docs.withColumns({f"_p_{n}": F.when(F.size(f"_l_{n}") > 0, F.expr(_scan(f"_l_{n}", "x + y"))).otherwise(F.expr(_NO_INTS)) for n in names})
    docs = docs.withColumns({f"_o_{n}": F.when(F.size(f"_m_{n}") > 0, F.expr(_offsets(n))).otherwise(F.array().cast(_SPAN)) for n in names})
    base = [
        f"transform(filter(transform(_o_{n}, x -> named_struct('start', x.start, 'm', x.m, 'd', regexp_replace(x.m, '[^0-9]', ''))), x -> {_valid(n)}), x -> named_struct('start', x.start, 'kind', {k}, 'end', x.start + length(x.m)))"
        for k, n in enumerate(BASE)
    ]
    docs = docs.withColumn("_base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    trees, limits = pii_model.model()
    total = " + ".join(_tree_sql(t) for t in trees)
    scored = [
        f"filter(transform(transform(_o_{n}, x -> named_struct('x', x, 'f', {_features_sql(g)})), y -> named_struct('start', y.x.start, 'less', -element_at(transform(array(y.f), f -> {total}), 1), 'kind', {KINDS.index(pii_model.KIND_OF[g])}, 'end', y.x.start + length(y.x.m))), y -> -y.less >= {limit!r}D)"
        for g, (n, limit) in enumerate(zip(pii_model.GENERATORS, limits))
        if limit != float("inf")
    ]
    none = "cast(array() as array<struct<start: int, less: double, kind: int, end: int>>)"
    docs = docs.withColumn("_candidates", F.expr(f"array_sort(concat({', '.join(scored or [none])}))"))
    # candidates among the base spans: one touches a base span if one before it ends later or one after it begins earlier
    docs = docs.withColumn("_all", F.expr("array_sort(concat(transform(_base, b -> named_struct('start', b.start, 'end', b.end, 'at', -1)), transform(_candidates, (c, i) -> named_struct('start', c.start, 'end', c.end, 'at', i))))"))
    docs = docs.withColumns({"_ends": F.expr("transform(_all, u -> if(u.at < 0, u.end, -1))"), "_starts": F.expr("reverse(transform(_all, u -> if(u.at < 0, u.start, 2147483647)))")})
    docs = docs.withColumns({"_before": F.expr(_scan("_ends", "greatest(x, y)")), "_after": F.expr(f"reverse({_scan('_starts', 'least(x, y)')})")})
    alone = "filter(transform(_all, (u, i) -> if(u.at >= 0 and _before[i] <= u.start and _after[i] >= u.end, u.at, -1)), k -> k >= 0)"
    docs = docs.withColumn("_free", F.when(F.size("_candidates") == 0, F.expr(none)).otherwise(F.expr(_let(f"transform({alone}, k -> _candidates[k])", "_all", "_before", "_after", "_candidates"))))
    docs = docs.withColumn("_free_ends", F.expr("transform(_free, c -> c.end)")).withColumn("_reach", F.expr(_scan("_free_ends", "greatest(x, y)")))
    docs = docs.withColumn("_heads", F.expr(_heads("_free", "_reach")))
    # a group of overlapping candidates: best score first, whatever overlaps none taken
    ranked = f"array_sort(transform(sequence(h, {_after('_heads', '_free')} - 1), i -> named_struct('less', _free[i].less, 'start', _free[i].start, 'kind', _free[i].kind, 'end', _free[i].end)))"
    span = "array<struct<start: int, kind: int, end: int>>"
    take = (
        f"aggregate({ranked}, cast(array() as {span}), (a, c) -> if(exists(a, b -> b.start < c.end and c.start < b.end), a, concat(a, array(named_struct('start', c.start, 'kind', c.kind, 'end', c.end)))))"
    )
    return docs.withColumn("_added", F.when(F.size("_free") == 0, F.expr(f"cast(array() as {span})")).otherwise(F.expr(_let(f"array_sort(flatten(transform(_heads, (h, k) -> {take})))", "_heads", "_free"))))


def _valid(name: str) -> str:
    return re.sub(r"(?<![A-Za-z_.'])(m|d)(?=[ ),])", r"x.\1", _VALID[name])


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the spans for every row of ``docs``."""
    rows = with_spans(docs.select("doc_id", F.col("text")), safe_text("text"))
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = {k})) as bigint)").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("array_sort(concat(_base, _added))").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; n_chars follows where it is a column."""
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_text"))
    rows = with_spans(row, safe_text("_text"))
    rows = rows.withColumn("_spans", F.expr("array_sort(concat(_base, _added))"))
    rows = rows.withColumn("_span_ends", F.expr("transform(_spans, s -> s.end)")).withColumn("_until", F.expr(_scan("_span_ends", "greatest(x, y)")))
    rows = rows.withColumn("_first", F.expr(_heads("_spans", "_until")))
    rows = rows.withColumn("_merged", F.expr(_let(f"transform(_first, (h, k) -> named_struct('start', _spans[h].start, 'kind', _spans[h].kind, 'end', _until[{_after('_first', '_spans')} - 1]))", "_first", "_spans", "_until")))
    # a substring costs its distance from the start, so the text is cut into blocks first
    rows = rows.withColumn("_blocks", F.when(F.size("_merged") > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    names = ", ".join(f"'{k.upper()}'" for k in KINDS)
    piece = (
        "if(a div {b} = z div {b}, substring(coalesce(get(_blocks, int(a div {b})), ''), a % {b} + 1, z - a), concat(substring(get(_blocks, int(a div {b})), a % {b} + 1),"
        " array_join(slice(_blocks, int(a div {b}) + 2, int(z div {b}) - int(a div {b}) - 1), ''), substring(coalesce(get(_blocks, int(z div {b})), ''), 1, z % {b})))"
    ).format(b=BLOCK)
    between = lambda a, z: f"element_at(transform(array(named_struct('a', {a}, 'z', {z})), r -> {re.sub(r'(?<![A-Za-z_])([az])(?![A-Za-z_])', r'r.\1', piece)}), 1)"
    pieces = f"transform(_merged, (s, i) -> concat({between('if(i = 0, 0, _merged[greatest(i, 1) - 1].end)', 's.start')}, '[', element_at(array({names}), s.kind + 1), ']'))"
    rest = between("element_at(_merged, -1).end", "length(_text)")
    rows = rows.withColumn("_new", F.when(F.size("_merged") == 0, F.col("_text")).otherwise(F.expr(_let(f"concat(array_join({pieces}, ''), {rest})", "_merged", "_blocks", "_text"))))
    kinds = {f.name: f.dataType for f in docs.schema}
    changed = {"text": F.col("_new"), "n_chars": F.length("_new").cast(kinds["n_chars"]) if "n_chars" in kinds else None}
    return rows.select(*[(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in columns])
