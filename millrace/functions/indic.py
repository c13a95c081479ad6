"""Indic scripts to ASCII: an ITRANS-like romanisation by rule.

The nine blocks share one layout, so a letter's place in its block names its sound.  A consonant carries the vowel a
unless a vowel sign or a virama follows.  Parity with other romanisers is approximate by nature.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import constants as K

# Sounds by place in the common block layout.
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x44: "RRI", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
CONSONANTS = [
    "k", "kh", "g", "gh", "~N", "ch", "Ch", "j", "jh", "~n", "T", "Th", "D", "Dh", "N", "t", "th", "d", "dh", "n", "n",
    "p", "ph", "b", "bh", "m", "y", "r", "R", "l", "L", "L", "v", "sh", "Sh", "s", "h",
]
MARKS = {0x01: "m", 0x02: "m", 0x03: "H", 0x50: "OM"}
VIRAMA, NUKTA, FIRST_CONSONANT, ZERO = 0x4D, 0x3C, 0x15, 0x66


def script_of(c: str) -> str | None:
    cp = ord(c)
    return next((n for n, (a, b) in K.SCRIPTS.items() if a <= cp <= b), None)


def romanise(text: str) -> str:
    """Each Indic letter by its sound; other characters stay."""
    out: list[str] = []
    pending = False  # a consonant waits for its vowel
    for c in unicodedata.normalize("NFC", text):
        if script_of(c) is None:
            out.append("a" * pending + c)
            pending = False
            continue
        place = ord(c) & 0x7F
        if pending and place in SIGNS:
            out.append(SIGNS[place])
            pending = False
        elif place == VIRAMA:
            pending = False
        elif place != NUKTA:
            out.append("a" * pending)
            pending = FIRST_CONSONANT <= place < FIRST_CONSONANT + len(CONSONANTS)
            if pending:
                out.append(CONSONANTS[place - FIRST_CONSONANT])
            elif ZERO <= place < ZERO + 10:
                out.append(str(place - ZERO))
            else:
                out.append(VOWELS.get(place) or MARKS.get(place) or SIGNS.get(place, ""))
    return "".join(out) + "a" * pending


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _clean(text: str) -> str:
    """Punctuation to blanks, ASCII, lower case, single blanks."""
    spaced = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text)
    return " ".join(fold(spaced).encode("ascii", "ignore").decode().lower().split())


def _legal(text: str) -> str:
    import re

    for pattern, short in K.DOTTED_LEGAL:
        text = re.sub(pattern, short, text, flags=re.IGNORECASE)
    return text


def romanised_name(text: str | None, script: str | None) -> str:
    """ASCII form of a name in one Indic script; empty for other names."""
    if not text or not text.strip() or script not in K.SCRIPTS:
        return ""
    return _clean(_legal(romanise(text)))


def romanised_address(text: str | None) -> str:
    """ASCII form of an address: runs of one Indic script are romanised, the rest is kept."""
    if text is None or text.strip().lower() in K.NULL_STRINGS:
        return ""
    if text.isascii():
        return text.lower()
    parts: list[tuple[str | None, str]] = []
    for c in text:
        script = script_of(c)
        if parts and parts[-1][0] == script:
            parts[-1] = script, parts[-1][1] + c
        else:
            parts.append((script, c))
    return _clean("".join((romanised_name(run, script) or run) if script else run for script, run in parts))


@F.pandas_udf(T.StringType())
def _names(text: pd.Series, script: pd.Series) -> pd.Series:
    return pd.Series([romanised_name(t, s) for t, s in zip(text, script, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def _addresses(text: pd.Series) -> pd.Series:
    return text.map(romanised_address)


def transliterate_name(name: Column, script: Column) -> Column:
    return _names(name, script)


def transliterate_address(address: Column, ascii_input: bool = False) -> Column:
    """ascii_input: no address has other characters, so no Python is planned."""
    missing = F.lower(F.trim(F.coalesce(address, F.lit("")))).isin(K.NULL_STRINGS)
    plain = F.when(missing, F.lit("")).otherwise(F.lower(address))
    return plain if ascii_input else F.when(address.rlike(r"^[\x00-\x7F]*$") | address.isNull(), plain).otherwise(_addresses(address))
