"""Audio files at the border of speech recognition: names, extensions and container marks. No audio is decoded here."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that are taken.
EXTENSIONS = [".mp3", ".m4a", ".wav", ".flac", ".ogg", ".opus", ".webm", ".aac", ".mp4", ".mpeg"]
EMPTY, UNKNOWN = "Uploaded file is empty", "Unsupported or invalid audio file"


def supported(header: Column) -> Column:
    """Whether a file's first bytes are those of a known audio container."""
    starts = lambda text: F.startswith(header, F.unhex(F.lit(text)))
    at = lambda a, n, text: F.substring(header, a, n) == F.unhex(F.lit(text))
    # ID3, fLaC, OggS, EBML; RIFF with WAVE; ftyp; an MPEG frame's eleven set bits
    known = starts("494433") | starts("664C6143") | starts("4F676753") | starts("1A45DFA3")
    riff = (F.octet_length(header) >= 12) & starts("52494646") & at(9, 4, "57415645")
    ftyp = (F.octet_length(header) >= 12) & at(5, 4, "66747970")
    second = F.conv(F.hex(F.substring(header, 2, 1)), 16, 10).cast("int")
    frame = (F.octet_length(header) >= 2) & starts("FF") & (second.bitwiseAND(224) == 224)
    return F.coalesce(known | riff | ftyp | frame, F.lit(False))


def header_error(header: Column) -> Column:
    return F.when(header.isNull() | (F.octet_length(header) == 0), EMPTY).when(~supported(header), UNKNOWN)


def extension(name: Column) -> Column:
    """A file name's extension in lower case; none for names that begin with their only dot."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"^.*[^.].*?(\.[^./]+)$|^[^.](\.[^./]+)$", 1))


def extension_allowed(name: Column) -> Column:
    return extension(name).isin(EXTENSIONS)


def safe_stem(name: str | None) -> str:
    """A file name's stem with nothing but letters, digits and . _ - in it."""
    base = (name or "transcription").rstrip("/").rpartition("/")[2]
    stem = base.rpartition(".")[0] if base.rpartition(".")[0].strip(".") and not base.endswith(".") else base
    text = "".join(c if c.isalnum() or c in "._-" else "_" for c in unicodedata.normalize("NFKC", stem or "transcription"))
    return re.sub("_+", "_", text).strip("._-") or "transcription"


def output_name(name: Column, at: Column, suffix: Column) -> Column:
    """A unique SRT file name: stem, time, eight hex digits."""
    stem = F.udf(safe_stem, "string", useArrow=True)
    return F.concat(stem(name), F.lit("_"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("_"), F.substring(suffix, 1, 8), F.lit(".srt"))


def recognised(files: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Segments of audio files by a provider's model; none comes with this package."""
    return files.mapInPandas(provider, schema)
