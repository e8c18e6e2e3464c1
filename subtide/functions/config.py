"""Settings of a model service from the environment, and the metrics of one request. The client itself is a caller's."""

from __future__ import annotations

import os
import time
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Words for yes and no; prefix of the variables; metrics that a request without them has.
YES, NO = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
PREFIX = "AI_CLEAN_"
METRICS = {"rule_based_ms": 0.0, "ai_call_ms": 0.0, "validation_ms": 0.0, "model": None, "provider": None}


def parse_bool(value: str | None, default: bool) -> bool:
    word = (value or "").strip().lower()
    return word in YES or (default and word not in NO)


def _number(kind, value: str | None, default, least):
    try:
        got = kind(value)
    except (TypeError, ValueError):
        return default
    return got if got >= least else default


def parse_float(value: str | None, default: float) -> float:
    """A number that is not negative, else the default."""
    return _number(float, value, default, 0)


def parse_int(value: str | None, default: int, minimum: int = 0) -> int:
    return _number(int, value, default, minimum)


@dataclass(frozen=True)
class CleanSettings:
    # The defaults.
    enabled: bool = True
    provider: str = "ollama"
    base_url: str = "http://localhost:11434"
    model: str = "qwen3:8b"
    timeout_seconds: float = 120.0
    temperature: float = 0.0
    num_predict: int = 2048
    format_json: bool = True
    think: bool = False

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None) -> CleanSettings:
        """Settings by variable; what is missing, blank or no value of its kind is the default."""
        source, made = os.environ if environ is None else environ, {}
        for f in fields(cls):
            value = source.get(PREFIX + f.name.upper())
            if isinstance(f.default, bool):
                made[f.name] = parse_bool(value, f.default)
            elif isinstance(f.default, float):
                made[f.name] = parse_float(value, f.default)
            elif isinstance(f.default, int):
                made[f.name] = parse_int(value, f.default, 1)
            else:
                made[f.name] = (value or f.default).strip()
        made["provider"] = made["provider"].lower() or cls.provider
        made["base_url"] = made["base_url"].rstrip("/") or cls.base_url
        return cls(**made)

    def client(self) -> dict[str, object]:
        """What a client of the service needs."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "enabled"}


def elapsed_ms(start: float) -> float:
    """Milliseconds since a time.perf_counter()."""
    return round((time.perf_counter() - start) * 1000, 3)


def finished(metrics: Mapping[str, object], start: float) -> dict[str, object]:
    """Metrics of a request that began at start, with those it lacks."""
    return METRICS | dict(metrics) | {"total_ms": elapsed_ms(start)}
