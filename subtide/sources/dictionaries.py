"""Correction, hint and phrase dictionaries: fixed values, and loading of replacements for them."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

logger = logging.getLogger(__name__)

# What speech recognition gets wrong, by language, and terms written with spaces.
COMMON_ZH = {
    "safe_replacements": {
        "滚瓜烂薯": "滚瓜烂熟", "滾瓜爛薯": "滾瓜爛熟", "没看过的生殖": "没看过的生词", "沒看過的生殖": "沒看過的生詞",
        "死机硬背": "死记硬背", "死機硬背": "死記硬背", "记忆供电法": "记忆宫殿法", "記憶供電法": "記憶宮殿法",
        "铁砾": "铁律", "鐵砾": "鐵律", "单负数": "单复数", "單負數": "單複數", "30%考材": "30%挑战", "30％考材": "30％挑战",
        "巨型替换训练": "句型替换训练", "巨型替換訓練": "句型替換訓練", "巨型替换": "句型替换", "巨型替換": "句型替換",
        "七手式": "起手式", "李柔不断替换": "例如不断替换", "李柔不斷替換": "例如不斷替換", "很有人眼": "很有吸引力",
        "对恋时": "对练时", "對戀時": "對練時",
    },
    "contextual_replacements": {"外教官": "外交官", "对恋": "对练", "對戀": "對練"},
}
SHARED = {
    "term_replacements": {"PatternDrill": "Pattern Drill", "whatImeanis": "what I mean is", "Ithink": "I think", "Chat GPT": "ChatGPT"},
    "terms": ["CIA", "MI6", "FSI", "Pattern Drill", "ChatGPT", "Gemini", "procrastinate", "what I mean is", "Honestly, I think", "可理解性输入", "可理解性輸入", "记忆宫殿法", "記憶宮殿法"],
}
BY_LANGUAGE = {"zh": COMMON_ZH, "ja": {}, "ko": {}}
# Hints for model corrections: (wrong, suggest, language, confidence, condition).
HINTS = [
    ("問答對聯", "問答對練", "zh", "high", "speaking practice / conversation drill context"),
    ("對戀", "對練", "zh", "high", "AI conversation practice context"),
    ("PatternDrill", "Pattern Drill", "any", "high", "English term spacing correction"),
    ("whatImeanis", "what I mean is", "any", "high", "English phrase spacing correction"),
    ("HonestlyIthink", "Honestly, I think", "any", "high", "English phrase spacing and punctuation correction"),
    ("자전거를탈수있어요", "자전거를 탈 수 있어요", "ko", "high", "Korean spacing correction"),
    ("일본생활은어때요", "일본 생활은 어때요", "ko", "high", "Korean spacing correction"),
    ("일주일에몇번가요", "일주일에 몇 번 가요", "ko", "high", "Korean spacing correction"),
    ("일주일에세번가요", "일주일에 세 번 가요", "ko", "high", "Korean spacing correction"),
    ("전혀안피곤해요", "전혀 안 피곤해요", "ko", "high", "Korean spacing correction"),
    ("아르바이트는몇시부터예요", "아르바이트는 몇 시부터예요", "ko", "high", "Korean spacing correction"),
    ("몇시", "몇 시", "ko", "high", "Korean spacing correction"),
    ("몇번", "몇 번", "ko", "high", "Korean spacing correction"),
    ("새벽1시까지해요", "새벽 1시까지 해요", "ko", "high", "Korean spacing correction"),
    ("저녁6시부터", "저녁 6시부터", "ko", "high", "Korean spacing correction"),
    ("몇시까지해요", "몇 시까지 해요", "ko", "high", "Korean spacing correction"),
    ("자전거를탈수있어요진짜요", "자전거를 탈 수 있어요? 진짜요", "ko", "medium", "Korean spacing and sentence boundary correction"),
]
PROTECTED_TERMS = ["CD", "DVD", "MP3", "PDF", "SRT", "FSI", "CIA", "MI6", "ChatGPT", "Gemini", "Claude", "Ollama", "Qwen", "DeepSeek", "Whisper", "faster-whisper", "Anki", "Quizlet", "TOEIC", "JLPT", "N1", "N2", "Pattern Drill"]
NUMERIC_RULES = {"preserve_arabic_digits": True, "do_not_convert_digits_to_kanji": True, "do_not_convert_half_width_to_full_width": True}
# Phrases that no line or cue break may cut.
PHRASES = [
    "深入探讨", "深入探討", "神经科学", "神經科學", "核心机制", "核心機制", "空间路径", "空間路徑", "自动反击", "自動反擊",
    "十分钟对话", "十分鐘對話", "可理解性输入", "可理解性輸入", "记忆宫殿法", "記憶宮殿法", "句型替换训练", "句型替換訓練",
    "严格的教官", "嚴格的教官", "严格", "嚴格", "Honestly, I think", "what I mean is", "Pattern Drill",
]


@dataclass
class Corrections:
    """Ordered maps of replacements and terms, of one language."""

    safe: dict[str, str] = field(default_factory=dict)
    contextual: dict[str, str] = field(default_factory=dict)
    terms_map: dict[str, str] = field(default_factory=dict)
    terms: list[str] = field(default_factory=list)


def string_map(payload: dict, key: str) -> dict[str, str]:
    """The map's entries of non-empty string to string; anything else is left out."""
    found = payload.get(key)
    return {k: v for k, v in found.items() if isinstance(k, str) and k and isinstance(v, str)} if isinstance(found, dict) else {}


def read_json(path: str | Path) -> object | None:
    """A JSON file's content; None, with a warning, if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        logger.warning("%s could not be loaded: %s", path, e)
        return None


def load_hints(path: str | Path | None = None) -> dict:
    """Hints, protected terms and numeric rules of a JSON file, by the keys below; {} if it is no JSON object.

    Without a path: the fixed ones.
    """
    if path is None:
        names = ("wrong", "suggest", "language", "confidence", "condition")
        return {"correction_hints": [dict(zip(names, h, strict=True)) for h in HINTS], "protected_terms": list(PROTECTED_TERMS), "numeric_rules": dict(NUMERIC_RULES)}
    found = read_json(path)
    if found is not None and not isinstance(found, dict):
        logger.warning("%s has no JSON object", path)
    return found if isinstance(found, dict) else {}


def merged(*payloads: dict) -> Corrections:
    """Later dictionaries override earlier ones by key; terms stay distinct, in order."""
    out = Corrections()
    for p in payloads:
        out.safe |= string_map(p, "safe_replacements")
        out.contextual |= string_map(p, "contextual_replacements")
        out.terms_map |= string_map(p, "term_replacements")
        listed = p.get("terms")
        out.terms += [t for t in dict.fromkeys(listed if isinstance(listed, list) else []) if isinstance(t, str) and t and t not in out.terms]
    return out


def flat(term: str) -> str:
    return " ".join(term.split())


def load_corrections(language: str | None = "auto", custom_terms: list[str] | None = None, folder: str | Path | None = None) -> Corrections:
    """Dictionaries of a language: its own, the shared one, custom terms, and rules that put a term's spaces back.

    folder: JSON files common_<language>.json and language_learning_terms.json instead of the fixed values.
    """
    lang = (language or "auto").strip().lower()
    if folder is None:
        own, shared = BY_LANGUAGE.get(lang, {}), SHARED
    else:
        read = lambda name: got if isinstance(got := read_json(Path(folder) / name), dict) else {}
        own, shared = read(f"common_{lang}.json") if lang in BY_LANGUAGE else {}, read("language_learning_terms.json")
    out = merged(own, shared)
    out.terms += [t for t in dict.fromkeys(flat(str(t)) for t in custom_terms or []) if t and t not in out.terms]
    for term in out.terms:
        solid = "".join(term.split())
        if solid and solid != flat(term):
            out.terms_map.setdefault(solid, flat(term))
    return out


def load_phrases(path: str | Path | None = None) -> list[str]:
    """Phrases of a JSON list or {"phrases": list}, trimmed, distinct, in order; the fixed ones if there are none."""
    payload = read_json(path) if path else None
    listed = payload.get("phrases") if isinstance(payload, dict) else payload
    found = dict.fromkeys(p.strip() for p in listed if isinstance(p, str)) if isinstance(listed, list) else {}
    return [p for p in found if p] or list(PHRASES)
