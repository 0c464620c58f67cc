"""Analysis of query texts on the driver: plain Python, no data involved."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from folianta.functions.text import ACCENTED, APOSTROPHES, PLAIN, ZERO_WIDTH

# Pairs of quotes that make a phrase, and names of months.
QUOTE_PAIRS = {'"': '"', "'": "'", chr(0x201C): chr(0x201D), chr(0x2018): chr(0x2019)}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def normalise(text: str | None) -> str:
    """As ``functions.text.normalise_for_search``, with compatibility composition."""
    out = []
    for c in unicodedata.normalize("NFKC", (text or "").strip()):
        if c in ZERO_WIDTH:
            continue
        if c == "'" or c in APOSTROPHES:
            out.append("'")
        elif c.isspace() or unicodedata.category(c)[0] in "PSZC":
            out.append(" ")
        else:
            up = c.upper()
            out.append(up if len(up) == 1 else c)
    return " ".join("".join(out).split())


def terms(normalised: str) -> list[str]:
    """Letters and digits with inner apostrophes; distinct, ignoring case, in order."""
    found = re.findall(r"[^\W_]+(?:'[^\W_]+)*", normalised)
    return list(dict.fromkeys(found))


def index_terms(term: str) -> list[str]:
    """How the index sees a query term: lower case, accents folded, cut at anything but letters and digits."""
    folded = term.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return [x for x in re.split(r"[\W_]+", folded) if x]


def exact_phrase(text: str | None) -> str | None:
    """The inside of a text in matching quotes; None without them."""
    t = (text or "").strip()
    if len(t) < 2 or QUOTE_PAIRS.get(t[0]) != t[-1]:
        return None
    return t[1:-1].strip()


@dataclass(frozen=True)
class Lookup:
    """A text that ends in a paragraph number."""

    text: str
    number: int


def paragraph_lookup(text: str | None) -> Lookup | None:
    """``faith 12`` is paragraph 12 of what matches ``faith``; needs white space before a positive number of up to four digits.

    Month and year (``December 2020``) are taken as a lookup too: it is tried before dates.
    """
    m = re.fullmatch(r"(.+?)\s+(\d{1,4})", (text or "").strip(), re.DOTALL)
    return Lookup(m[1].strip(), int(m[2])) if m and int(m[2]) > 0 else None


@dataclass(frozen=True)
class DateIntent:
    month: str
    low: int
    high: int


def date_intent(text: str | None) -> DateIntent | None:
    """A month by name or abbreviation and a year or the beginning of one, in either order.

    Four digits are a year, three a decade, 20 and 19 their centuries (to 2029 and 1999); other
    two-digit numbers mean nothing.
    """
    words = re.findall(r"[A-Za-z]+|\d+", text or "")
    month = next((m for w in words for m in MONTHS if len(w) >= 3 and m.startswith(w.lower())), None)
    digits = next((w for w in words if w.isdigit()), None)
    if month is None or digits is None:
        return None
    if len(digits) == 4:
        return DateIntent(month, int(digits), int(digits))
    if len(digits) == 3:
        return DateIntent(month, int(digits) * 10, int(digits) * 10 + 9)
    if digits == "20":
        return DateIntent(month, 2000, 2029)
    return DateIntent(month, 1900, 1999) if digits == "19" else None


def scope(one: int | None, allowed: Sequence[int] | None) -> list[int] | None:
    """Ids that a search may see: None is no restriction, an empty list matches nothing."""
    if allowed is None:
        return None if one is None else [one]
    ids = sorted(set(allowed))
    return ids if one is None else [i for i in ids if i == one]


@dataclass(frozen=True)
class SearchQuery:
    """A structured search; empty fields don't restrict."""

    text: str | None = None
    title: str | None = None
    code: str | None = None
    keyword: str | None = None
    author_id: int | None = None
    source_id: int | None = None
    year: int | None = None
    paragraph: int | None = None
    limit: int = 50
    language: str | None = None
    sources: Sequence[int] | None = field(default=None)
