"""Globs over whole paths, as anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RULES = 64
MAX_RULE_BYTES = 255


def glob_regex(pattern: str) -> str:
    """`?` is one character but "/", `*` any number of them, `**` anything at all, and a "/" after it is part of it."""
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", pattern):
        out.append("(?s:.*)" if part.startswith("**") else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part))
    return r"\A" + "".join(out) + r"\z"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def check_rules(rules: list[tuple[str, str]]) -> None:
    """rules: ("include" | "exclude", glob), in order."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    for kind, pattern in rules:
        if kind not in ("include", "exclude"):
            raise ValueError(f"unknown rule kind {kind!r}")
        if not pattern or len(pattern.encode()) > MAX_RULE_BYTES:
            raise ValueError(f"a rule must have 1 to {MAX_RULE_BYTES} bytes")


def first_match_excludes(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether the first rule that matches is an exclude; no match includes."""
    check_rules(rules)
    out = F.lit(False)
    for kind, pattern in reversed(rules):
        out = F.when(glob_match(path, pattern), kind == "exclude").otherwise(out)
    return out
