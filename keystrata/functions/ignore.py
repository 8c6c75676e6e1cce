"""Ignore rules in gitignore's manner: the last rule that matches decides.

A rule becomes one regular expression over the path below its own directory,
so a table of rules is a table of expressions that ``rlike`` can use.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES_FILE = ".ignore"


class _Bad(ValueError):
    pass


def glob_regex(glob: str) -> str:
    """A shell pattern for one path component as a regular expression; raises on a malformed one."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if at == len(glob):
                raise _Bad(glob)
            out.append(re.escape(glob[at]))
            at += 1
        elif c == "[":
            negated = glob[at : at + 1] == "^"
            at += negated
            parts = []
            while True:
                if at >= len(glob):
                    raise _Bad(glob)
                if glob[at] == "]" and parts:
                    at += 1
                    break
                ends = []
                for _ in range(2):
                    if at >= len(glob) or glob[at] in "-]" and not ends:
                        raise _Bad(glob)
                    if glob[at] == "\\":
                        at += 1
                        if at >= len(glob):
                            raise _Bad(glob)
                    ends.append(glob[at])
                    at += 1
                    if at < len(glob) and glob[at] == "-" and len(ends) == 1:
                        at += 1
                        continue
                    break
                low, high = ends[0], ends[-1]
                if low <= high:
                    parts.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}" if low != high else f"\\x{{{ord(low):x}}}")
                else:
                    parts.append("")  # an empty range matches nothing
            inner = "".join(parts)
            out.append(f"[^/{inner}]" if negated else f"(?![/])[{inner}]" if inner else "(?!)")
        else:
            out.append(re.escape(c))
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    domain: str
    order: int
    include: bool
    dir_only: bool
    regex: str | None  # over the path below the domain; None matches nothing
    anchored: bool


def parse_rule(line: str, domain: str, order: int) -> Rule | None:
    """A line of a rules file; None for blanks and comments."""
    line = line.removesuffix("\r")
    if line.startswith("#") or not line.strip():
        return None
    include = line.startswith("!")
    line = line[include:]
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    dir_only = line.endswith("/")
    line = line.removesuffix("/") if dir_only else line
    parts = line.split("/")
    try:
        if len(parts) == 1:
            # a floating rule may match any component; the last one must be a directory if it says so
            return Rule(domain, order, include, dir_only, f"(?:.*/)?{glob_regex(parts[0])}", False)
        out, jump = [], False
        steps = []
        for k, p in enumerate(parts):
            if p == "":
                jump = False
            elif p == "**":
                if k == len(parts) - 1:
                    break
                jump = True
            elif "**" in p:
                raise _Bad(p)
            else:
                steps.append((jump, glob_regex(p)))
                jump = False
        if not steps:
            return Rule(domain, order, include, dir_only, None, True)
        for k, (jump, p) in enumerate(steps):
            out.append(("/" if k else "") + ("(?:[^/]*/)*?" if jump else "") + p)
        return Rule(domain, order, include, dir_only, "".join(out), True)
    except _Bad:
        return Rule(domain, order, include, dir_only, None, True)


def parse_file(text: str, domain: str, first: int = 0) -> list[Rule]:
    return [r for k, line in enumerate(text.split("\n")) if (r := parse_rule(line, domain, first + k)) is not None]


def _matches(rule: Rule, path: str, is_dir: bool) -> bool:
    if rule.regex is None:
        return False
    if rule.domain:
        if not path.startswith(rule.domain + "/"):
            return False
        path = path[len(rule.domain) + 1 :]
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), rule.regex)
    if rule.dir_only and not is_dir:
        return re.fullmatch(f"(?s:{pattern})/.*", path) is not None
    return re.fullmatch(f"(?s:{pattern})(?:/.*)?", path) is not None


def _ordered(rules: list[Rule]) -> list[Rule]:
    """Nearer directories' rules after those above them, each file's in order."""
    return sorted(rules, key=lambda r: (r.domain.count("/") + bool(r.domain), r.order))


def ignored(rules: list[Rule], path: str, is_dir: bool) -> bool:
    """Whether a path is left out: it or a directory above it is. A rules file is so only by its directory."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here, directory = "/".join(parts[:k]), k < len(parts) or is_dir
        if not directory and parts[-1] == RULES_FILE:
            return False
        last = next((r for r in reversed(_ordered(rules)) if _matches(r, here, directory)), None)
        if last is not None and not last.include:
            return True
    return False


def mark_ignored(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """``entries`` (path, is_dir) with ``ignored``, by one expression over all rules and no Python per row."""

    def decide(path, is_dir):
        out = F.lit(False)
        for r in _ordered(rules):
            if r.regex is None:
                continue
            front = re.escape(r.domain + "/") if r.domain else ""
            below, whole = path.rlike(f"^{front}(?s:{r.regex})/.*$"), path.rlike(f"^{front}(?s:{r.regex})(?:/.*)?$")
            out = F.when(F.when(~is_dir, below).otherwise(whole) if r.dir_only else whole, F.lit(not r.include)).otherwise(out)
        return out

    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    pruned = F.when(F.size(parts) > 1, F.exists(above, lambda p: decide(p, F.lit(True)))).otherwise(False)
    own = ~F.col("is_dir") & (F.element_at(parts, -1) == RULES_FILE)
    return entries.withColumn("ignored", pruned | (~own & decide(F.col("path"), F.col("is_dir"))))
