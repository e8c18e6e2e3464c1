"""Text expressions on subtitle cues. All are built-in JVM expressions and work inside higher-order functions too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets and limits of the two rule sets.
SPACE = r"[\s\x1c-\x1f]"
CJK = "[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"
PUNCTUATION = "、。，．！？!?…；;：:,，"
OPENERS, CLOSERS = r"（(\[「『【", r"）」』】)\]"
CUT_WORDS = ("了", "嘛", "吗", "呢", "吧", "啊", "哦", "啦", "咯", "对", "没错")
SENTENCE_END, CLAUSE_END = r"""[。．！？!?…]+["'」』）\])]*$""", r"""[、，,;；:：]+["'」』）\])]*$"""
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
QUALITY = {"min_gap": 0.084, "min_duration": 0.5, "max_duration": 10.0, "cjk_line": 24, "latin_line": 42, "lines": 2, "cjk_cps": 12.0, "latin_cps": 20.0}
PRO = {"cjk_line": 21, "latin_line": 42, "cjk_cps": 9.0, "latin_cps": 17.0}


def replaced(text: Column, pattern: str, by: str) -> Column:
    """regexp_replace with Unicode classes."""
    return F.regexp_replace(text, "(?U)" + pattern, by)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return replaced(text, rf"^{SPACE}+|{SPACE}+$", "")


def unified(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r", "\n")


def reading_chars(text: Column) -> Column:
    return F.length(replaced(text, rf"{SPACE}+", ""))


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def sentence_end(text: Column) -> Column:
    return strip(text).rlike(SENTENCE_END)


def soft_boundary(text: Column) -> Column:
    return strip(text).rlike(CLAUSE_END)


def natural_cut(text: Column) -> Column:
    words = strip(text).rlike(f"({'|'.join(CUT_WORDS)})$")
    return sentence_end(text) | soft_boundary(text) | (contains_cjk(text) & words)


def line_limit(text: Column, limits: dict = PRO) -> Column:
    return F.when(contains_cjk(text), limits["cjk_line"]).otherwise(limits["latin_line"])


def cps_limit(text: Column, limits: dict = PRO) -> Column:
    return F.when(contains_cjk(text), limits["cjk_cps"]).otherwise(limits["latin_cps"])


def flatten(text: Column) -> Column:
    """One line: a break disappears beside punctuation, brackets and CJK and between ASCII letters or digits, else it is a space."""
    out = strip(unified(text))
    out = F.regexp_replace(out, "[ \t\f\x0b]+", " ")
    out = F.regexp_replace(out, " *\n[ \n]*", "\n")
    # a white space run loses its breaks by the read character before it, the one behind it, or both
    cjk, blank = CJK[1:-1], rf"([{SPACE[1:-1]}&&[^\n]]*)"
    behind = lambda letters: rf"(?:(?<=[{letters}])|(?!^)\G){blank}\n"
    out = replaced(out, behind(OPENERS + cjk), "$1")
    out = replaced(out, rf"\n(?={SPACE}*[{PUNCTUATION}{CLOSERS}{cjk}])", "")
    out = replaced(out, behind("A-Za-z0-9") + rf"(?={SPACE}*[A-Za-z0-9])", "$1")
    out = F.regexp_replace(out, "\n", " ")
    out = F.regexp_replace(out, " {2,}", " ")
    return strip(replaced(out, rf"{SPACE}+([{PUNCTUATION}])", "$1"))


def words_text(words: Column) -> Column:
    """Words of one cue: joined without separator, spaces collapsed, none before punctuation."""
    out = replaced(strip(F.array_join(words, "")), rf"{SPACE}+", " ")
    return strip(replaced(out, rf"{SPACE}+([、。，．！？!?…])", "$1"))


def joins_without_space(left: Column, right: Column) -> Column:
    return right.rlike(rf"^[、。，．！？!?）」』】\]]|^(ページ|頁|課|番)|^{CJK}") | left.rlike(rf"{CJK}$")


def joined(left: Column, right: Column) -> Column:
    a, b = flatten(left), flatten(right)
    return F.when(a == "", b).when(b == "", a).when(joins_without_space(a, b), F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def page_fragment(left: Column, right: Column) -> Column:
    return flatten(left).rlike(r"(?U)\d+\s*[%％]?$") & flatten(right).rlike("^(ページ|頁)$")


# The format rules, in order.
FORMAT_RULES = [
    (r"(\d+)\s*[%％]\s*(ページ|頁)", "$1$2"),
    (r"第\s*(\d+)\s*課", "第$1課"),
    (r"第\s+(\d+)", "第$1"),
    (r"(\d+)\s+(ページ|頁|課|番)", "$1$2"),
    (r"\s+([、。，．！？!?])", "$1"),
]


def format_rules() -> list:
    """Functions of the format rules, one a rule."""
    return [lambda t, p=p.replace(r"\s", SPACE), by=by: replaced(t, p, by) for p, by in FORMAT_RULES]


_READ = "[^" + SPACE[1:]
_COMMA = f"{_READ}{SPACE}*,{SPACE}*{_READ}"


def chinese_punctuation(text: Column) -> Column:
    """Full-width commas beside CJK and question and exclamation marks after it.

    A comma's match takes its neighbours with it, so a letter between two commas belongs to the first only.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?U){_COMMA}|[\s\S]"), F.lit(0))
    beside = rf"^(?:{CJK}{SPACE}*,|{_READ}{SPACE}*,{SPACE}*{CJK}$)"
    wide = F.transform(pieces, lambda p: F.when((F.length(p) > 1) & p.rlike("(?U)" + beside), replaced(p, f"^({_READ}){SPACE}*,{SPACE}*({_READ})$", "$1，$2")).otherwise(p))
    out = F.when(F.contains(text, F.lit(",")), F.array_join(wide, "")).otherwise(text)
    out = replaced(out, rf"({CJK}){SPACE}*,{SPACE}*$", "$1，")
    return F.regexp_replace(F.regexp_replace(out, rf"(?<={CJK})\?", "？"), rf"(?<={CJK})!", "！")


def count_of(text: Column, letters: str) -> Column:
    return F.regexp_count(text, F.lit(letters))


def hangul(text: Column) -> Column:
    return count_of(text, "[\uac00-\ud7af]")


def kana(text: Column) -> Column:
    return count_of(text, "[\u3040-\u30ff]")


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,:/-][0-9]+)*"), F.lit(0))
