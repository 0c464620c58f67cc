"""Songs: refrains, choruses, the order of sections, and line breaks restored from a source."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least characters of a line, a repeated window and a shared hook.
LINE, WINDOW, HOOK = 11, 24, 16
_REPEAT = re.compile(r"\(?\b(?:bis|ter|x ?[2-4]|[2-4] ?x)\b\)?", re.IGNORECASE)
_INVISIBLE = frozenset(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD)))


def line_key(line: str) -> str:
    """Letters, digits and single spaces, lower case."""
    return " ".join(re.sub(r"[\W_]+", " ", line.lower()).split())


def stanza_key(lines: Sequence[str]) -> str:
    return " ".join(k for k in map(line_key, lines) if k)


def repeats_inside(line: str) -> bool:
    """Whether a line says the same words twice in a row, as refrains do."""
    w = line_key(line).split()
    return any(w[i : i + n] == w[i + n : i + 2 * n] for n in range(2, len(w) // 2 + 1) for i in range(len(w) - 2 * n + 1))


def find_refrain(lines: Sequence[str]) -> list[str] | None:
    """Four lines of the form ABAB, those with a repeat inside first; else the longest window of 4 to 2 lines that comes again.

    A window of two lines must come again twice.
    """
    keys = [line_key(x) for x in lines]
    alternating = [i for i in range(len(keys) - 3) if len(keys[i]) >= LINE and keys[i] == keys[i + 2] and keys[i + 1] == keys[i + 3] and keys[i] != keys[i + 1]]
    if alternating:
        best = next((i for i in alternating if repeats_inside(lines[i])), alternating[0])
        return list(lines[best : best + 4])
    for size in (4, 3, 2):
        windows = [stanza_key(lines[i : i + size]) for i in range(len(lines) - size + 1)]
        for i, key in enumerate(windows):
            if len(key) >= WINDOW and windows[i + size :].count(key) >= (2 if size == 2 else 1):
                return list(lines[i : i + size])
    return None


def find_chorus(stanzas: Sequence[Sequence[str]]) -> list[str] | None:
    """The stanza that repeats, else one with a mark of repetition or ABAB, else the second if it takes up the first one's last line."""
    if len(stanzas) < 2:
        return None
    keys = [stanza_key(s) for s in stanzas]
    for key, s in zip(keys, stanzas, strict=True):
        if len(key) >= WINDOW and keys.count(key) > 1:
            return list(s)
    for s in stanzas:
        k = [line_key(x) for x in s]
        if len(s) >= 2 and (any(_REPEAT.search(x) for x in s) or (len(s) >= 4 and k[0] == k[2] and k[1] == k[3])):
            return list(s)
    second = stanzas[1]
    hook = line_key(stanzas[0][-1])
    if any(repeats_inside(x) or _REPEAT.search(x) or _takes_up(hook, line_key(x)) for x in second):
        return list(second)
    return None


def _takes_up(hook: str, line: str) -> bool:
    if min(len(hook), len(line)) < HOOK:
        return False
    return hook in line or line in hook or hook[-HOOK:] == line[-HOOK:]


def interleaved(kinds: Column, texts: Column) -> Column:
    """Texts of sections with the first chorus after each verse, unless every verse is followed by one already.

    ``kinds`` holds 'Chorus' or another type for each text.
    """
    pairs = F.arrays_zip(kinds.alias("k"), texts.alias("t"))
    chorus = F.filter(pairs, lambda p: p["k"] == "Chorus")
    verses = F.filter(pairs, lambda p: p["k"] != "Chorus")
    broken = F.exists(F.sequence(F.lit(0), F.greatest(F.size(kinds) - 2, F.lit(0))), lambda i: (F.get(kinds, i) == "Verse") & F.coalesce(F.get(kinds, i + 1) != "Chorus", F.lit(False)))
    done = ~broken & (F.size(chorus) >= F.greatest(F.lit(1), F.size(verses) - 1))
    woven = F.flatten(F.transform(verses, lambda v: F.array(v["t"], F.get(chorus, F.lit(0))["t"])))
    return F.when((F.size(chorus) == 0) | (F.size(verses) == 0) | done, texts).otherwise(woven)


def visible(text: str) -> str:
    """Characters that count when a stored text is held against its source."""
    return "".join(c for c in text if not c.isspace() and c.isprintable() and c not in _INVISIBLE)


def restore_breaks(stored: str | None, source: Sequence[str] | None) -> str | None:
    """The stored text broken into lines where the source is; None unless both hold the same visible characters."""
    if stored is None or source is None:
        return None
    lengths = [len(visible(x)) for x in source if visible(x)]
    if visible(stored) != "".join(map(visible, source)):
        return None
    out, at = [], 0
    for n in lengths:
        start, seen = at, 0
        while at < len(stored) and seen < n:
            seen += len(visible(stored[at]))
            at += 1
        out.append(stored[start:at])
    if out:
        out[-1] += stored[at:]
    return "\n".join(" ".join(x.split()) for x in out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def refrain(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else find_refrain(list(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def chorus(stanzas: pd.Series) -> pd.Series:
    """Stanzas as texts with line breaks."""
    return stanzas.map(lambda x: None if x is None else find_chorus([s.split("\n") for s in x if s]))


@F.pandas_udf(T.StringType())
def with_breaks(stored: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([restore_breaks(a, None if b is None else list(b)) for a, b in zip(stored, source, strict=True)])
