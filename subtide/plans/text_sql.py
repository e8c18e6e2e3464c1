"""Text operators as DuckDB SQL, for comparison: each function takes SQL of a text and gives SQL of the result.

DuckDB's patterns have no look-around, so a neighbour that only has to be there is captured and put back.
"""

from __future__ import annotations

import re

from subtide.functions.text import CLOSERS, CUT_WORDS, FORMAT_RULES, OPENERS, PUNCTUATION
from subtide.sources.dictionaries import load_corrections

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = "぀-ヿ㐀-鿿가-힯"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def strip(text: str) -> str:
    return sub(text, f"^{SPACE}+|{SPACE}+$", "")


def chars(text: str) -> str:
    return f"length({sub(text, f'{SPACE}+', '')})"


def flatten(text: str) -> str:
    """Lines one after the other, each with or without a space before it."""
    one = sub(sub(strip(f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"), r"[ \t\f\x0b]+", " "), r" *\n[ \n]*", "\n")
    glued = f"{has('a', f'[{OPENERS}{CJK}]{SPACE}*$')} OR {has('b', f'^{SPACE}*[{PUNCTUATION}{CLOSERS}{CJK}]')} OR ({has('a', f'[A-Za-z0-9]{SPACE}*$')} AND {has('b', f'^{SPACE}*[A-Za-z0-9]')})"
    lines = f"list_reduce(string_split({one}, chr(10)), lambda a, b: a || CASE WHEN {glued} THEN '' ELSE ' ' END || b)"
    return strip(sub(sub(lines, " {2,}", " "), f"{SPACE}+([{PUNCTUATION}])", r"\1"))


def joined(a: str, b: str) -> str:
    """Two flat texts as one."""
    tight = f"{has(b, f'^([、。，．！？!?）」』】{chr(92)}]]|ページ|頁|課|番|[{CJK}])')} OR {has(a, f'[{CJK}]$')}"
    return f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {tight} THEN {a} || {b} ELSE {a} || ' ' || {b} END"


def page(a: str, b: str) -> str:
    return f"({has(a, f'[0-9]+{SPACE}*[%％]?$')} AND {b} IN ('ページ', '頁'))"


def format_rules(text: str) -> list[str]:
    """The text after each format rule."""
    out = []
    for pattern, by in FORMAT_RULES:
        text = sub(text, pattern.replace(r"\s", SPACE), by.replace("$", "\\"))
        out.append(text)
    return out


def chinese_punctuation(text: str) -> str:
    read = "[^" + SPACE[1:]
    comma = f"^({read}){SPACE}*,{SPACE}*({read})$"
    beside = f"(left(p, 1) SIMILAR TO '[{CJK}]' OR right(p, 1) SIMILAR TO '[{CJK}]')"
    pieces = f"regexp_extract_all({text}, {quoted(f'{read}{SPACE}*,{SPACE}*{read}|[^,]|,')}, 0, 's')"
    out = f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN {has('p', comma)} AND {beside} THEN {sub('p', comma, chr(92) + '1，' + chr(92) + '2')} ELSE p END), '')"
    out = sub(out, f"([{CJK}]){SPACE}*,{SPACE}*$", r"\1，")
    return sub(sub(out, rf"([{CJK}])\?", r"\1？"), f"([{CJK}])!", r"\1！")


def replaced(text: str, before: str, after: str) -> str:
    """A dictionary rule; short ASCII words are replaced as whole words, twice, as neighbours share a border."""
    if not re.fullmatch(r"[A-Za-z0-9_+-]{1,6}", before):
        return f"replace({text}, {quoted(before)}, {quoted(after)})"
    for _ in range(2):
        text = sub(text, f"(^|[^A-Za-z0-9_]){re.escape(before)}([^A-Za-z0-9_]|$)", rf"\1{after}\2")
    return text


def clean_steps(language: str, contextual: bool, terms: list[str] | None = None) -> list[tuple[str, str | None, str | None, object]]:
    """(type, before, after, SQL function) of every rule, in order."""
    rules = load_corrections(language, terms)
    groups = [("safe_replacement", rules.safe), ("term_replacement", rules.terms_map)] + [("contextual_replacement", rules.contextual)] * contextual
    out: list = []
    for kind, group in groups:
        out += [(kind, b, a, lambda t, b=b, a=a: replaced(t, b, a)) for b, a in sorted((r for r in group.items() if r[0] != r[1]), key=lambda r: -len(r[0]))]
    out += [("format_normalization", None, None, lambda t, n=n: format_rules(t)[n] if n == 0 else sub(t, FORMAT_RULES[n][0].replace(r"\s", SPACE), FORMAT_RULES[n][1].replace("$", "\\"))) for n in range(len(FORMAT_RULES))]
    return out + [("punctuation_normalization", None, None, chinese_punctuation)] * (language == "zh")


def cleaned(rows: str, text: str, language: str, contextual: bool = False, terms: list[str] | None = None) -> str:
    """A query over rows: all their columns, t0 (flat text), t1, t2, ... (after each rule)."""
    made = ", ".join(f"{f(f't{n}')} AS t{n + 1}" for n, (_, _, _, f) in enumerate(clean_steps(language, contextual, terms)))
    return f"SELECT *, {flatten(text)} AS t0, {made} FROM {rows}"


def changes(language: str, contextual: bool = False, terms: list[str] | None = None) -> str:
    """List of (before, after, type) over the columns of cleaned()."""
    made = [
        f"CASE WHEN t{n} <> t{n + 1} THEN {{'before': {f't{n}' if b is None else quoted(b)}, 'after': {f't{n + 1}' if b is None else quoted(a)}, 'type': {quoted(kind)}}} END"
        for n, (kind, b, a, _) in enumerate(clean_steps(language, contextual, terms))
    ]
    return f"list_filter([{', '.join(made)}], lambda c: c IS NOT NULL)"


def last(language: str, contextual: bool = False, terms: list[str] | None = None) -> str:
    return strip(f"t{len(clean_steps(language, contextual, terms))}")


def natural_end(text: str) -> str:
    return has(text, f"({'|'.join(CUT_WORDS)})$")
