"""Ranges of a text to highlight for a query. Places in the original text need Python: normalising moves them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianta.functions import analyze as an

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def normalise_with_places(text: str) -> tuple[str, list[int]]:
    """The normalised text, and for each of its characters the place it comes from."""
    out: list[str] = []
    places: list[int] = []
    for i, raw in enumerate(text):
        for c in unicodedata.normalize("NFKC", raw):
            one = an.normalise(f"x{c}x")[1:-1]
            for d in one or (" " if one == "" and an.normalise(c) == "" and c not in an.ZERO_WIDTH else ""):
                if d == " " and (not out or out[-1] == " "):
                    continue
                out.append(d)
                places.append(i)
    while out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ranges_of(text: str | None, query: str) -> list[dict[str, int]]:
    """Ranges of the phrase where it occurs, else of its terms as whole words."""
    quoted = an.exact_phrase(query)
    norm = an.normalise(quoted if quoted is not None else query)
    if not text or not norm:
        return []
    flat, places = normalise_with_places(text)
    spans = [(m.start(), m.end()) for m in re.finditer(re.escape(norm), flat)]
    if not spans and quoted is None:
        wanted = set(an.terms(norm))
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:'[^\W_]+)*", flat) if m[0] in wanted]
    return [{"start": a, "length": b - a} for a, b in merge([(places[a], places[b - 1] + 1) for a, b in spans])]


def highlights(query: str):
    """A pandas UDF from texts to their ranges for one query."""

    @F.pandas_udf(RANGES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ranges_of(t, query))

    return run
