"""Column builders shared by the operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
VERDICTS = ("pass", "partial", "fail", "unknown", "not_applicable")
#: Weights in tenths by severity.
SEVERITY_WEIGHTS = {"critical": 50, "high": 30, "medium": 20, "low": 10, "info": 0}


def choose(name: Column, values: dict, default=None) -> Column:
    """A small lookup as a CASE expression, which stays inside generated code."""
    return reduce(lambda e, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(e), reversed(values.items()), F.lit(default))


def severity_rank(name: Column) -> Column:
    """info 0 to critical 4; unknown or null -1."""
    return choose(name, {s: i for i, s in enumerate(SEVERITIES)}, -1)


def severity_weight(name: Column, weight: Column | None = None) -> Column:
    """The explicit weight in tenths, else the severity's."""
    own = choose(name, SEVERITY_WEIGHTS, 0)
    return own if weight is None else F.coalesce(weight, own)


def effective_verdict(verdict: Column, status: Column) -> Column:
    """What a finding counts as: verified verdicts count, all else is unknown."""
    return F.when((status == "verified") & verdict.isin("pass", "partial", "fail", "not_applicable"), verdict).otherwise("unknown")


def grade(tenths: Column) -> Column:
    """A from 8.5, B from 7, C from 5.5, D from 4, else E; null for null."""
    return F.when(tenths >= 85, "A").when(tenths >= 70, "B").when(tenths >= 55, "C").when(tenths >= 40, "D").when(tenths.isNotNull(), "E")


def ratio_1e4(part: Column, whole: Column) -> Column:
    """part / whole in ten-thousandths, half up; null for a zero denominator. Integers in, integers out."""
    return F.when(whole != 0, F.call_function("div", part.cast("long") * 20000 + whole, whole * 2))


def clamp(value: Column, low, high, default) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def trim_claim(text: Column, most: int = 300) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression.

    ``*`` and ``?`` stop at a slash, ``**`` crosses folders, braces alternate, and
    a leading dot is an ordinary letter.
    """
    out, i, depth = "", 0, 0
    while i < len(pattern):
        rest, c = pattern[i:], pattern[i]
        if rest.startswith("**/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if rest.startswith("**"):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            body = rest[1:end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i += end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
