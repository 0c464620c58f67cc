"""Text functions as columns; Python only where Spark has no equal (Unicode normalisation)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are treated alike.
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0xFFFD)))
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
SINGLE_QUOTES = "".join(map(chr, range(0x2018, 0x201C)))
DOUBLE_QUOTES = "".join(map(chr, range(0x201C, 0x2020)))
DASHES = "".join(map(chr, (*range(0x2010, 0x2015), 0x2212)))
APOSTROPHES = SINGLE_QUOTES + "`" + chr(0xB4)
# Words that scans tend to print letter by letter.
SPACED_WORDS = (
    "THE SPOKEN WORD GOD LORD JESUS CHRIST SPIRIT WHAT HEAREST THOU ELIJAH WEDDING SUPPER SEED HEIR WITH SHUCK NOT "
    "IS OF AND IN ON TO BE IT HE WE MY BY AS AT OR NO ME UP"
).split()

_MARK = "\u0001"


def once(column: Column) -> Column:
    """A costly column that is to be computed once per row, however often it is used.

    Filters and projections above would else be merged into the one below, each use with a
    computation of its own; the optimizer never duplicates an expression with a row number in it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def upper_keeping_sharp_s(text: Column) -> Column:
    """Upper case, but a sharp s stays as it is."""
    return F.replace(F.upper(F.replace(text, F.lit("ß"), F.lit(_MARK))), F.lit(_MARK), F.lit("ß"))


def collapsed_upper(text: Column) -> Column:
    """Collapsed white space, upper case."""
    return upper_keeping_sharp_s(flatten_spaces(text))


def search_text(text: Column) -> Column:
    """The form in which paragraphs are searched: compatibility forms composed, cleaned as extracted text, upper case; empty for null."""
    return upper_keeping_sharp_s(clean_extracted(composed(text)))


def composed(text: Column) -> Column:
    """``nfkc``; Python sees only texts with more than ASCII and the accented letters of Latin 1, which are composed already."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F\u00C0-\u00FF]"), text)), text)


def normalise_for_search(text: Column) -> Column:
    """A query or text for matching: compatibility forms composed, apostrophes unified, other punctuation, symbols and controls as spaces, collapsed, upper case."""
    plain = F.translate(composed(text), APOSTROPHES + ZERO_WIDTH, "'" * len(APOSTROPHES))
    return upper_keeping_sharp_s(F.trim(F.regexp_replace(plain, r"[[\p{P}\p{S}\p{Z}\p{C}]&&[^']]+", " ")))


def tokens(normalised: Column) -> Column:
    """Words of letters and digits with inner apostrophes."""
    return F.regexp_extract_all(normalised, F.lit(r"[\p{L}\p{Nd}]+(?:'[\p{L}\p{Nd}]+)*"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens of the inverted index: lower case, common Latin accents folded, runs of letters and digits."""
    return F.filter(F.split(fold_accents(F.lower(text)), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


# Lower-case Latin letters with a mark, and the letter below it.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(text: Column) -> Column:
    """Common lower-case accented Latin letters without their marks; texts without any pass untouched."""
    return F.when(text.rlike(f"[{ACCENTED}]"), F.translate(text, ACCENTED, PLAIN)).otherwise(text)


def preview(text: Column, length: int = 240, ellipsis: str = "...") -> Column:
    """The first ``length`` characters, with an ellipsis where something is cut."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length), F.lit(ellipsis)))


def contains_folded(text: Column, part: str) -> Column:
    """Contains, ignoring ASCII case; LIKE's wildcards in ``part`` are ordinary characters."""
    return F.contains(ascii_lower(text), F.lit(_ascii_lower(part)))


def starts_folded(text: Column, part: str) -> Column:
    """Starts with, ignoring ASCII case."""
    return F.startswith(ascii_lower(text), F.lit(_ascii_lower(part)))


def equals_folded(text: Column, other: str) -> Column:
    """Equal, ignoring ASCII case."""
    return ascii_lower(text) == F.lit(_ascii_lower(other))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UP, _LOW)


def _ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(_UP, _LOW))


def flatten_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x0B]+", " "))


def shorten(text: Column, length: int) -> Column:
    """Collapsed white space, at most ``length`` characters with the ellipsis counted."""
    flat = flatten_spaces(text)
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, length - 3)), F.lit("...")))


def alnum_key(text: Column, upper: bool = True) -> Column:
    """Letters and digits only."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")
    return upper_keeping_sharp_s(bare) if upper else F.lower(bare)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\x0B]+"), lambda x: x != ""))


def line_count(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\s\x0B]+", "") != ""))


def leading_number(text: Column) -> Column:
    """A number from 1 to 999 that opens a paragraph, before white space or a stop and white space; else null."""
    n = F.regexp_extract(text, r"^\s*(\d{1,3})(?:[.)]?\s+)\S", 1).try_cast("int")
    return F.when(n >= 1, n)


def without_leading_number(text: Column) -> Column:
    return F.when(leading_number(text).isNotNull(), F.regexp_replace(text, r"^\s*\d{1,3}[.)]?\s+", "")).otherwise(text)


def snippet(text: Column, term: str, before: int = 55, length: int = 170) -> Column:
    """A stretch of ``length`` characters that begins ``before`` characters ahead of the first hit; ellipses mark cuts."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    body = F.substring(text, start, F.lit(length))
    whole = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.trim(body), F.when(start + length - 1 < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(at == 0, preview(text, length)).otherwise(whole)


def readable_ratio(text: Column) -> Column:
    """Share of letters and digits among visible characters; 0 without any."""
    visible = F.length(F.regexp_replace(text, r"[\s\x0B]", ""))
    good = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    return F.when(visible > 0, good / visible).otherwise(0.0)


def symbol_ratio(text: Column) -> Column:
    """Share of visible characters that are neither letters, digits nor common punctuation."""
    visible = F.length(F.regexp_replace(text, r"[\s\x0B]", ""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s\x0B.,;:!?'\"()\[\]/&-]", ""))
    return F.when(visible > 0, odd / visible).otherwise(0.0)


#: Letters of any script with their marks, and digits among them, so that the end of an accented word (FÜR) or of a key (A3D) is no single letter.
_RUN = re.compile(r"(?:[^\W\d_]|[\u0300-\u036F'’])+(?:\d+(?:[^\W\d_]|[\u0300-\u036F'’])+)*")
_KNOWN = frozenset(SPACED_WORDS)
#: Single capitals that stand alone in prose, and most of them that are put before one word.
_ALONE, _MOST = "AIO", 6
#: Words that Y is put before; before others it stands alone, in Spanish (Y DE) and French (Y EST).
_OF_Y = frozenset("YEA YEAR YEARS YEARN YEAST YELL YELLOW YESTERDAY YET YIELD YIELDED YOKE YONDER YOU YOUNG YOUNGER YOUR YOURS YOURSELF YOURSELVES YOUTH".split())
#: Capitals that open a word and aren't followed by other ASCII letters.
_CAPITALS = re.compile(r"[A-Z]{2,}(?![A-Za-z'’])")


def join_letters(text: str) -> str:
    """Words that were printed letter by letter, put together.

    The text is taken as runs of letters. Neighbouring runs with nothing but white space between them
    are a spaced word if they spell a known one, either all as single letters (T H E) or as a first
    letter and the rest (W HAT); or if the first also holds the article (AT HE: A THE). Of spellings
    that share a run the longest wins. Then single capitals join the run of capitals after them (G LORY),
    Y only where that makes an English word.
    """
    runs = [[m.start(), m.end(), m[0]] for m in _RUN.finditer(text)]
    near = [text[x[1] : y[0]].isspace() for x, y in zip(runs, runs[1:], strict=False)] + [False] * bool(runs)
    found = []  # (length of the word, first run, last run, new text)
    for i, (_, _, first) in enumerate(runs):
        if not near[i]:
            continue
        after = runs[i + 1][2]
        if len(first) == 1 and first + after in _KNOWN:
            found.append((-1 - len(after), i, i + 1, first + after))
        if len(first) == 2 and first[0] == "A" != first[1] and len(after) > 1 and first[1] + after in _KNOWN:
            found.append((-1 - len(after), i, i + 1, f"A {first[1:]}{after}"))
        word, j = first, i
        while len(runs[j][2]) == 1 and near[j] and len(runs[j + 1][2]) == 1:
            j += 1
            word += runs[j][2]
            if word in _KNOWN and j > i + 1:
                found.append((-len(word), i, j, word))
    taken = [False] * len(runs)
    for _, i, j, new in sorted(found):
        if not any(taken[i : j + 1]):
            taken[i : j + 1] = [True] * (j + 1 - i)
            runs[i][1:] = [runs[j][1], new]
            near[i] = near[j]
            for k in range(i + 1, j + 1):
                runs[k] = None
    kept = [(r, n) for r, n in zip(runs, near, strict=True) if r is not None]
    out: list[str] = []
    start, joined, word = len(text), 0, ""
    for (low, high, run), beside in reversed(kept):
        single = len(run) == 1 and "A" <= run <= "Z" and run not in _ALONE and (run != "Y" or run + word in _OF_Y)
        if beside and single and joined < _MOST and _CAPITALS.match(word):
            out.append(run)
            joined, word = joined + 1, run + word
        else:
            out += [text[high:start], run]
            joined, word = 0, run.rpartition(" ")[2]
        start = low
    return text[:start] + "".join(reversed(out))


@F.pandas_udf(T.StringType())
def _joined_letters(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else join_letters(x))


def repair_spacing(text: Column) -> Column:
    """``join_letters``; Python sees only texts that have two capitals with white space between."""
    return F.coalesce(_joined_letters(F.when(text.rlike(r"[A-Z]\s+[A-Z]"), text)), text)


def has_letter_spacing(text: Column) -> Column:
    """Whether ``join_letters`` would change the text."""
    return repair_spacing(text) != text


def _ruled(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, text)


# What is put right in extracted text, as (where, what stands there afterwards). The order is
# part of the behaviour: a hyphen at a line's end parts a word and goes, a dash there doesn't, so dashes are
# settled while they still differ from hyphens.
DASH_AT_LINE_END = ((r"(?<=[–—])[ \t]*\R\s*", ""),)
EXTRACTED = (
    (r"\b([Ii])(?i:spast)\b", "$1s past"),
    (r"-\s*\R\s*", ""),
    (r"([,;:!?])(?=[\p{L}\p{N}])", "$1 "),
    (r"([a-z]\.)(?=[A-Z])", "$1 "),
)
BEFORE_PUNCTUATION = ((r"\s+(?=[,.;:!?%\])])", ""),)
#: Lines: runs of blanks are one, none stands at a line's end or start, and two lines at most are empty together.
LINES = ((r"\r\n?", "\n"), (r"[ \t\f\x0B]{2,}", " "), (r" ?\t? *\n[ \t]*", "\n"), (r"\n\s*\n\s*\n\s*", "\n\n"))


def clean_display(text: Column) -> Column:
    """Text for display: byte-order marks gone, letter-spaced words repaired, spaces before punctuation and blank lines reduced."""
    return _spaced(repair_spacing(_bare(text)))


def _bare(text: Column) -> Column:
    return F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\ufeff"), F.lit("")))


def _spaced(text: Column) -> Column:
    return F.trim(_ruled(text, (*BEFORE_PUNCTUATION, *LINES[1:])))


def clean_extracted(text: Column, preserve_lines: bool = False) -> Column:
    """Extracted text made readable, in one line or with its lines.

    Characters are unified without compatibility decomposition; apply ``nfkc`` first where that is wanted.
    """
    return clean_display(_readable(text, preserve_lines))


def _readable(text: Column, preserve_lines: bool = False) -> Column:
    out = unify_characters(_ruled(F.coalesce(text, F.lit("")), DASH_AT_LINE_END))
    out = _ruled(out, (*EXTRACTED, *BEFORE_PUNCTUATION))
    return _ruled(F.regexp_replace(out, r"[\t\f\x0B]", " "), LINES) if preserve_lines else flatten_spaces(out)


def with_search_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``search_text``; each step is computed once, where the column alone would repeat those before a step in Python."""
    out = rows.withColumn("__s", once(composed(F.col(text))))
    out = out.withColumn("__s", once(_bare(_readable(F.col("__s")))))
    out = out.withColumn("__s", once(repair_spacing(F.col("__s"))))
    return out.withColumn("search_text", upper_keeping_sharp_s(_spaced(F.col("__s")))).drop("__s")


def unify_characters(text: Column) -> Column:
    """Spaces, quotes and dashes in their ASCII form; zero-width, private, unassigned and control characters dropped."""
    source = SPACES + SINGLE_QUOTES + DOUBLE_QUOTES + DASHES
    target = " " * len(SPACES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)
    out = F.translate(F.replace(text, F.lit("…"), F.lit("...")), source + ZERO_WIDTH, target)
    return F.regexp_replace(out, r"[\p{Co}\p{Cn}\p{Cs}]|[\p{Cc}&&[^\n\r\t]]", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it."""
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def song_key(text: pd.Series) -> pd.Series:
    """Text of songs for matching: decomposed, marks stripped, runs of punctuation and space as one space, upper case."""

    def one(x: str | None) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.category(c).startswith("M"))
        return re.sub(r"[\W_]+", " ", bare).strip().upper()

    return text.map(one)


def song_key_native(text: Column) -> Column:
    """``song_key`` for texts whose accents are common Latin ones, without Python."""
    folded = F.upper(F.replace(fold_accents(F.lower(text)), F.lit("ß"), F.lit(_MARK)))
    return F.trim(F.regexp_replace(F.replace(folded, F.lit(_MARK), F.lit("ß")), r"[^\p{L}\p{N}]+", " "))


def without_editor_notes(text: Column, most: int = 3) -> Column:
    """Up to ``most`` bracketed notes taken from a paragraph's beginning."""
    out = text
    for _ in range(most):
        out = F.regexp_replace(out, r"^\s*\[[^\]]*\]\s*", "")
    return out


def email_of(text: Column) -> Column:
    """A trimmed, lower-case address, or null where it isn't one."""
    low = F.lower(F.trim(text))
    return F.when((F.length(low) <= 254) & low.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), low)
