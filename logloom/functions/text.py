"""Text expressions: everything here is a Catalyst expression, no Python runs on the rows.

White space is Unicode white space together with U+001C to U+001F.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.schema import LEVELS, WILDCARD

BLANK = r"\s\x1C-\x1F"
#: Fixed value: the format specifiers that become holes.
FORMAT_SPECIFIER = r"%[+-]?[0-9]*\.?[0-9]*[diouxXeEfFgGaAcsSn]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"(?U)^[{BLANK}]+|[{BLANK}]+$", "")


def tokens(text: Column | str) -> Column:
    """Words between white space."""
    return F.regexp_extract_all(col(text), F.lit(rf"(?U)[^{BLANK}]+"), 0)


def static_token_count(pattern: Column | str) -> Column:
    return F.size(F.filter(tokens(pattern), lambda t: t != WILDCARD))


def template_id(path: Column | str, line: Column | str, pattern: Column | str, variant: Column | str) -> Column:
    """First 16 hex digits of the md5 of path, line, pattern and variant."""
    parts = [col(c).cast("string") for c in (path, line, pattern, variant)]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16)


def confidence(static: Column, n: Column, template_tokens: Column, holes: Column) -> Column:
    """Share of static tokens, more if lengths agree, less if holes are wide; between 0 and 1, and 0 for no tokens.

    Captured tokens always sum to n minus the static tokens, so the average width needs no capture: ``holes`` counts the captures,
    ``template_tokens`` the pattern's tokens.
    """
    same = F.when(n == template_tokens, 0.1).otherwise(0.0)
    wide = F.when((holes > 0) & ((n - template_tokens + holes) / holes > 5), 0.1).otherwise(0.0)
    raw = static / n + same - wide
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).otherwise(0.0)


def holes_from_format(text: Column | str) -> Column:
    return F.regexp_replace(col(text), FORMAT_SPECIFIER, WILDCARD)


def unescape_braces(text: Column | str) -> Column:
    return F.replace(col(text), F.lit(r"\{\}"), F.lit("{}"))


def holes_from_braces(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("{}"), F.lit(WILDCARD))


def unquote(text: Column | str) -> Column:
    """Without one pair of double or single quotes; escapes stay as they are."""
    return F.regexp_replace(col(text), r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")


def level_of(method: Column | str) -> Column:
    low = F.lower(col(method))
    return F.when(low.isin(*LEVELS), low).otherwise("unknown")


def location_text(location: Column | str) -> Column:
    """path:class:X:method:Y:line:N without empty parts."""
    at = col(location)
    part = lambda name, field: F.when(F.coalesce(at[field], F.lit("")) != "", F.concat(F.lit(name), at[field]))
    return F.concat_ws(":", at["file_path"], part("class:", "class_name"), part("method:", "method_name"), F.concat(F.lit("line:"), at["line_number"].cast("string")))


def three_decimals(value: Column | str) -> Column:
    """A number from 0 to 1 as ``%.3f`` prints it: its exact binary value, rounded to the nearest and ties to even.

    ``format_string`` rounds the shortest decimal form instead (1/16 gives 0.063, and 0.5375 gives 0.538 where 0.537 is nearer). Here all
    steps are exact: the number's bits are cut into two whole numbers, of units of 2^-40 and 2^-90.
    """
    unit, part = 1 << 40, 1 << 50

    def cut(v: Column) -> Column:
        high = F.floor(v * float(unit))
        return F.struct(high.alias("high"), (F.floor((v * float(unit) - high) * float(part)) * 1000).alias("low"))

    def carried(x: Column) -> Column:
        return F.struct((x["high"] * 1000 + F.shiftright(x["low"], 50)).alias("high"), x["low"].bitwiseAND(F.lit(part - 1)).alias("low"))

    def rounded(x: Column) -> Column:
        whole, rest = F.shiftright(x["high"], 40), x["high"].bitwiseAND(F.lit(unit - 1))
        return whole + F.when((rest > unit // 2) | ((rest == unit // 2) & ((x["low"] > 0) | (whole % 2 == 1))), 1).otherwise(0)

    def printed(n: Column) -> Column:
        return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))

    # Each step sees the one before as a bound variable, so that no expression is repeated.
    steps = F.array(col(value).cast("double"))
    for step in (cut, carried, rounded, printed):
        steps = F.transform(steps, step)
    return F.get(steps, F.lit(0))


def match_text(template: Column | str, score: Column | str, location: Column | str) -> Column:
    """A match on one line: Match(template_id=.., confidence=.., location=..)."""
    return F.concat(F.lit("Match(template_id="), col(template), F.lit(", confidence="), three_decimals(score), F.lit(", location="), location_text(location), F.lit(")"))


def shortened(text: Column | str, most: int, mark: str = "...") -> Column:
    c = col(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def glob_regex(glob: str) -> str:
    """A shell pattern (``*`` crosses ``/``, ``?``, ``[..]``, ``[!..]``) as a regular expression for whole strings."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "]") else i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", c))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def like_any(path: Column | str, globs: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | col(path).rlike(glob_regex(g))
    return out
