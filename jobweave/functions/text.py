"""Requirement text as column expressions: normalise, section, split, classify."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv

# Everything the text counts as white space, as a character set for trim and as
# the inside of a regex class (``\s`` in Java covers ASCII only).
WHITE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
WHITE_CLASS = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def wide(pattern: str) -> str:
    """Make ``\\s`` and ``\\d`` of a pattern cover Unicode white space and digits."""
    return pattern.replace(r"\d", r"\p{Nd}").replace(r"[,;；\s]", f"[,;；{WHITE_CLASS}]").replace(
        r"\s*", f"[{WHITE_CLASS}]*"
    )


@dataclass(frozen=True)
class TextRules:
    """The patterns that section and classify a text; other languages bring their own."""

    header: str = fv.SECTION_HEADER
    line_start: str = fv.SECTION_LINE_START
    end: str = fv.SECTION_END
    heading: str = fv.BARE_HEADING
    ignore: tuple[str, ...] = field(default_factory=lambda: tuple(fv.IGNORE))
    education: str = fv.EDUCATION
    age: str = fv.AGE
    age_blocked_by: str = fv.AGE_BLOCKED_BY
    experience: str = fv.EXPERIENCE
    skill: str = fv.SKILL


DEFAULT_RULES = TextRules()


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _replace(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether ``pattern`` occurs in ``text``.

    Plain alternatives are looked for as substrings, which is far cheaper than
    trying every one of a long alternation at every character; the others stay
    one regular expression.
    """
    options = [pattern] if re.search(r"[(\[]", pattern) else pattern.split("|")
    special = re.compile(r"[.^$*+?{}\[\]\\()|]")
    plain = [o for o in options if not special.search(o) and not (ignore_case and o.lower() != o.upper())]
    rest = "|".join(wide(o) for o in options if o not in plain)
    tests = [text.contains(o) for o in plain]
    if rest:
        tests.append(text.rlike(("(?i)" if ignore_case else "") + rest))
    return reduce(or_, tests)


def normalize_text(text: Column) -> Column:
    """CR to LF, wide blank to blank, ends stripped; null becomes empty."""
    return strip(_replace(F.coalesce(text, F.lit("")), {"\r": "\n", "\u3000": " "}))


def one_line(text: Column) -> Column:
    """Line breaks to the segment joiner, ends stripped; null becomes empty."""
    return strip(_replace(F.coalesce(text, F.lit("")), {"\n": fv.OTHER_JOINER, "\r": fv.OTHER_JOINER}))


def clean_line(line: Column) -> Column:
    """Strip bullets and brackets at both ends, then leading colons."""
    bare = F.btrim(F.coalesce(line, F.lit("")), F.lit(WHITE + fv.BULLETS))
    return strip(F.ltrim(bare, F.lit(fv.LEADING_COLONS)))


def split_lines(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    """Cleaned, non-empty lines that are not bare headings."""
    lines = F.transform(F.split(normalize_text(text), wide(f"{fv.SENTENCE_ENDS}|{fv.COLONS}|{LINE_BREAK}")), clean_line)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(wide(rules.heading)))


def requirement_section(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    """The part after the first header and before the first end header; else the whole text."""
    whole = normalize_text(text)
    tail = F.coalesce(
        F.get(F.split(whole, wide(rules.header), 2), 1),
        F.get(F.split(whole, wide(rules.line_start), 2), 1),
    )
    return F.coalesce(F.get(F.split(tail, wide(rules.end), 2), 0), whole)


def line_segments(lines: Column) -> Column:
    """Lines cut at commas and semicolons into cleaned, non-empty segments."""
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, fv.SEGMENT_BREAK)))
    return F.filter(F.transform(parts, clean_line), lambda x: x != "")


def is_ignored(line: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return reduce(or_, [_matches(line, p, ignore_case=True) for p in rules.ignore], line == "")


def classify_line(line: Column, rules: TextRules = DEFAULT_RULES, unmatched: str | None = "other") -> Column:
    """Label of a line by the first rule that fires; ``unmatched`` when none does."""

    def label(text: Column) -> Column:
        return (
            F.when(is_ignored(text, rules), "ignore")
            .when(_matches(text, rules.education), "other")
            .when(_matches(text, rules.age) & ~_matches(text, rules.age_blocked_by), "other")
            .when(_matches(text, rules.experience), "experience")
            .when(_matches(text, rules.skill), "skill")
            .otherwise(F.lit(unmatched))
        )

    # bound once: written inline, the cleaned text would be computed again for every rule
    return F.transform(F.array(clean_line(line)), label)[0]


def requirement_segments(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return line_segments(split_lines(requirement_section(text, rules), rules))


def other_requirement(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    """The segments no rule assigns elsewhere, joined; one projection, no shuffle."""
    kept = F.filter(requirement_segments(text, rules), lambda x: classify_line(x, rules) == "other")
    return F.array_join(kept, fv.OTHER_JOINER)


def phrases(text: Column, min_chars: int = fv.PHRASE_MIN_CHARS) -> Column:
    """Pieces of a text between punctuation marks, at least ``min_chars`` long."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), fv.PHRASE_BREAKS), strip)
    return F.filter(pieces, lambda x: F.length(x) >= min_chars)


def tag_list(tags: Column) -> Column:
    """Tags of an embedding lookup: also cut at white space."""
    return F.filter(F.split(F.coalesce(tags, F.lit("")), wide(fv.TAG_BREAK)), lambda x: strip(x) != "")


def tag_items(tags: Column) -> Column:
    """Tags that are a list already: stripped, empty and missing ones left out, not cut any further."""
    bare = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: strip(x.cast("string")))
    return F.filter(bare, lambda x: F.coalesce(x, F.lit("")) != "")


def sentence_list(text: Column) -> Column:
    """A text as a list of zero or one non-empty sentences."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))
