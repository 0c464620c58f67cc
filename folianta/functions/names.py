"""Names of files, works and sections: paths, languages, codes, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a section's type, and words in paths that tell a language.
SECTION_WORDS = {"chorus": "Chorus", "refrain": "Chorus", "chœur": "Chorus", "bridge": "Bridge", "intro": "Intro", "ending": "Ending", "verse": "Verse", "couplet": "Verse", "strophe": "Verse"}
LANGUAGE_WORDS = {"fr": ("french", "français", "francais"), "sw": ("swahili", "kiswahili"), "de": ("german", "deutsch"), "es": ("spanish", "español"), "en": ("english",)}
# Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def base_name(path: Column) -> Column:
    """File name without folder and extension; a browser's copy mark `` (2)`` is dropped."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"\s*\(\d+\)$", "")


def path_key(path: Column) -> Column:
    """Slashes and case unified, a copy mark dropped: equal for the same file."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\s*\(\d+\)(\.[A-Za-z0-9]{1,5})$", "$1"))


def language_of_path(path: Column, default: str = "en") -> Column:
    """By a two-letter folder or prefix, else by words in the path, else the default."""
    low = F.lower(path)
    folder = F.regexp_extract(low, r"(?:^|/)(fr|sw|de|es|en)(?:/|[-_])", 1)
    out = F.when(folder != "", folder)
    for code, words in LANGUAGE_WORDS.items():
        out = out.when(low.rlike("|".join(words)), code)
    return out.otherwise(default)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "-"), "^-|-$", "")


def publication_code(prefix: str, year: Column, month: Column, title: Column) -> Column:
    """``PREFIX-YYYY-MM-slug``; an unknown month is 00, and the prefix isn't repeated."""
    s = slug(title)
    bare = F.when(s.startswith(prefix.lower() + "-"), F.substring(s, len(prefix) + 2, 1000)).otherwise(s)
    return F.concat_ws("-", F.lit(prefix), F.lpad(F.coalesce(year, F.lit(0)).cast("string"), 4, "0"), F.lpad(F.coalesce(month, F.lit(0)).cast("string"), 2, "0"), bare)


def clean_title(text: Column) -> Column:
    """Underscores as spaces, a leading code and a publisher's suffix dropped, spaces collapsed, stops trimmed from the ends."""
    out = F.regexp_replace(text, "_", " ")
    out = F.regexp_replace(out, r"^\s*[A-Z]{1,4}-?\d{2,6}[A-Z]?\s*[-–:]?\s+", "")
    out = F.regexp_replace(out, r"(?i)\s*[-–|]\s*(?:published by|publisher|www\.)\s.*$", "")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[ .,;:-]+|[ ,;:-]+$", "")


def title_case(text: Column) -> Column:
    """Capital first letters but for small words inside."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    one = lambda w, i: F.when((i > 0) & w.isin(list(SMALL_WORDS)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000)))
    return F.array_join(F.transform(words, one), " ")


def section_type(label: Column) -> Column:
    """Chorus, Bridge, Intro, Ending or Verse by the label's first words; a bare number is a verse; else Section."""
    low = F.lower(F.trim(label))
    out = F.when(low.rlike(r"^\d+\s*[.)]?$"), "Verse")
    for word, kind in SECTION_WORDS.items():
        out = out.when(low.startswith(word), kind)
    return out.otherwise("Section")
