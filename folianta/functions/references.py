"""References to books, chapters and verses, and names of books in three languages."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 66 books in canonical order, with short, French and Swahili names.
BOOKS = (
    "Genesis|Exodus|Leviticus|Numbers|Deuteronomy|Joshua|Judges|Ruth|1 Samuel|2 Samuel|1 Kings|2 Kings|1 Chronicles|2 Chronicles|"
    "Ezra|Nehemiah|Esther|Job|Psalms|Proverbs|Ecclesiastes|Song of Solomon|Isaiah|Jeremiah|Lamentations|Ezekiel|Daniel|Hosea|Joel|"
    "Amos|Obadiah|Jonah|Micah|Nahum|Habakkuk|Zephaniah|Haggai|Zechariah|Malachi|Matthew|Mark|Luke|John|Acts|Romans|1 Corinthians|"
    "2 Corinthians|Galatians|Ephesians|Philippians|Colossians|1 Thessalonians|2 Thessalonians|1 Timothy|2 Timothy|Titus|Philemon|"
    "Hebrews|James|1 Peter|2 Peter|1 John|2 John|3 John|Jude|Revelation"
).split("|")
SHORT = (
    "Gen|Exo|Lev|Num|Deu|Jos|Jdg|Rut|1Sa|2Sa|1Ki|2Ki|1Ch|2Ch|Ezr|Neh|Est|Job|Psa|Pro|Ecc|Sng|Isa|Jer|Lam|Ezk|Dan|Hos|Jol|Amo|Oba|Jon|"
    "Mic|Nam|Hab|Zep|Hag|Zec|Mal|Mat|Mrk|Luk|Jhn|Act|Rom|1Co|2Co|Gal|Eph|Php|Col|1Th|2Th|1Ti|2Ti|Tit|Phm|Heb|Jas|1Pe|2Pe|1Jn|2Jn|3Jn|Jud|Rev"
).split("|")
FRENCH = (
    "Genèse|Exode|Lévitique|Nombres|Deutéronome|Josué|Juges|Ruth|1 Samuel|2 Samuel|1 Rois|2 Rois|1 Chroniques|2 Chroniques|Esdras|"
    "Néhémie|Esther|Job|Psaumes|Proverbes|Ecclésiaste|Cantique des Cantiques|Ésaïe|Jérémie|Lamentations|Ézéchiel|Daniel|Osée|Joël|Amos|"
    "Abdias|Jonas|Michée|Nahum|Habacuc|Sophonie|Aggée|Zacharie|Malachie|Matthieu|Marc|Luc|Jean|Actes|Romains|1 Corinthiens|"
    "2 Corinthiens|Galates|Éphésiens|Philippiens|Colossiens|1 Thessaloniciens|2 Thessaloniciens|1 Timothée|2 Timothée|Tite|Philémon|"
    "Hébreux|Jacques|1 Pierre|2 Pierre|1 Jean|2 Jean|3 Jean|Jude|Apocalypse"
).split("|")
SWAHILI = (
    "Mwanzo|Kutoka|Mambo ya Walawi|Hesabu|Kumbukumbu la Torati|Yoshua|Waamuzi|Ruthu|1 Samweli|2 Samweli|1 Wafalme|2 Wafalme|"
    "1 Mambo ya Nyakati|2 Mambo ya Nyakati|Ezra|Nehemia|Esta|Ayubu|Zaburi|Mithali|Mhubiri|Wimbo Ulio Bora|Isaya|Yeremia|Maombolezo|"
    "Ezekieli|Danieli|Hosea|Yoeli|Amosi|Obadia|Yona|Mika|Nahumu|Habakuki|Sefania|Hagai|Zekaria|Malaki|Mathayo|Marko|Luka|Yohana|Matendo|"
    "Warumi|1 Wakorintho|2 Wakorintho|Wagalatia|Waefeso|Wafilipi|Wakolosai|1 Wathesalonike|2 Wathesalonike|1 Timotheo|2 Timotheo|Tito|"
    "Filemoni|Waebrania|Yakobo|1 Petro|2 Petro|1 Yohana|2 Yohana|3 Yohana|Yuda|Ufunuo"
).split("|")
# Further English abbreviations.
ABBREVIATIONS = {
    "Deut": "Deuteronomy", "Josh": "Joshua", "Judg": "Judges", "1 Sam": "1 Samuel", "2 Sam": "2 Samuel", "1 Kgs": "1 Kings", "2 Kgs": "2 Kings",
    "Psalm": "Psalms", "Ps": "Psalms", "Prov": "Proverbs", "Matt": "Matthew", "Mk": "Mark", "Lk": "Luke", "Jn": "John", "1 Cor": "1 Corinthians",
    "2 Cor": "2 Corinthians", "Phil": "Philippians", "1 Thess": "1 Thessalonians", "2 Thess": "2 Thessalonians", "1 Tim": "1 Timothy", "2 Tim": "2 Timothy",
}
# Ordinals before a book's name.
ORDINALS = {"first ": "1 ", "second ": "2 ", "third ": "3 ", "1st ": "1 ", "2nd ": "2 ", "3rd ": "3 "}


def book_key(name: str) -> str:
    """Lower case, no stops, single spaces, ordinals as digits."""
    key = " ".join(name.replace(".", "").split()).lower()
    for word, digit in ORDINALS.items():
        key = key.replace(word, digit)
    return key


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def _aliases() -> dict[str, int]:
    """Key of every known name, with and without spaces and accents, to the book's number from 1."""
    out: dict[str, int] = {}
    places = {b: i for i, b in enumerate(BOOKS, 1)}
    named = [(n, i) for names in (BOOKS, SHORT) for i, n in enumerate(names, 1)] + [(a, places[b]) for a, b in ABBREVIATIONS.items()]
    named += [(n, i) for names in (FRENCH, SWAHILI) for i, n in enumerate(names, 1)]
    for name, i in named:
        for form in (name, _plain(name)):
            out.setdefault(book_key(form), i)
            out.setdefault(book_key(form.replace(" ", "")), i)
    return out


ALIASES = _aliases()


@dataclass(frozen=True)
class Reference:
    """book_id from 1 (0: none); ``error`` says what is wrong, and is empty for a good reference."""

    book_id: int
    chapter: int
    verse: int | None
    error: str = ""

    @property
    def valid(self) -> bool:
        return not self.error

    @property
    def book(self) -> str:
        return BOOKS[self.book_id - 1] if self.book_id else ""


def parse_reference(text: str) -> Reference:
    """``Book chapter``, ``Book chapter:verse`` or ``Book chapter verse``."""
    words = re.fullmatch(r"((?:[1-3]\s*)?[^\W\d_]+(?:\s+[^\W\d_]+)*?)\s+(\d{1,3})(?:(?:\s*:\s*|\s+)(\d{1,3}))?", " ".join(text.split()))
    if not words:
        return Reference(0, 0, None, "not a reference")
    book = ALIASES.get(book_key(words[1]), 0)
    if not book:
        return Reference(0, 0, None, f"unknown book: {words[1]}")
    if int(words[2]) < 1:
        return Reference(book, 0, None, "chapter must be positive")
    if words[3] is not None and int(words[3]) < 1:
        return Reference(book, int(words[2]), None, "verse must be positive")
    return Reference(book, int(words[2]), int(words[3]) if words[3] else None)


def matching_books(text: str, limit: int = 12) -> list[str]:
    """Books with a name that begins like the text, with or without spaces, in canonical order."""
    flat = " ".join(text.split())
    digits = re.search(r"\d", flat)
    key = book_key(flat[: digits.start()].strip() if digits and digits.start() else flat)
    if not key:
        return []
    compact = key.replace(" ", "")
    found = {i for alias, i in ALIASES.items() if alias.startswith(key) or alias.replace(" ", "").startswith(compact)}
    return [BOOKS[i - 1] for i in sorted(found)][:limit]


@dataclass(frozen=True)
class Target:
    """Where a navigation text leads; ``keyword`` where it names no place."""

    book_id: int = 0
    chapter: int | None = None
    verse: int | None = None
    keyword: str | None = None


def navigate(text: str, current_book: int | None) -> Target:
    """A number in the current book, a reference, the beginning of a book's name, else a keyword; the first that fits."""
    flat = " ".join(text.split())
    here = re.fullmatch(r"(\d{1,3})(?:\s*:\s*(\d{1,3}))?", flat)
    if current_book and here:
        return Target(current_book, int(here[1]), int(here[2]) if here[2] else None)
    ref = parse_reference(flat)
    if ref.valid:
        return Target(ref.book_id, ref.chapter, ref.verse)
    books = matching_books(flat)
    return Target(BOOKS.index(books[0]) + 1) if books else Target(keyword=flat)


def display_name(book_id: int, language: str) -> str:
    """Name in French or Swahili, else in English."""
    names = {"fr": FRENCH, "sw": SWAHILI}.get(language.lower(), BOOKS)
    return names[book_id - 1] if 1 <= book_id <= len(names) else ""


def alias_frame(spark: SparkSession) -> DataFrame:
    """(alias, book_id): a few hundred rows of fixed number."""
    return spark.createDataFrame(sorted(ALIASES.items()), "alias string, book_id int")


def name_frame(spark: SparkSession) -> DataFrame:
    """(book_id, language, name) in en, fr and sw."""
    rows = [(i, lang, n) for lang, names in (("en", BOOKS), ("fr", FRENCH), ("sw", SWAHILI)) for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "book_id int, language string, name string")


def reference_parts(text: Column) -> Column:
    """struct of key (of the book's name), chapter and verse as columns; nulls where the text isn't a reference."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    pattern = r"^((?:[1-3]\s*)?\p{L}+(?:\s+\p{L}+)*?)\s+(\d{1,3})(?:(?:\s*:\s*|\s+)(\d{1,3}))?$"
    key = F.lower(F.replace(F.regexp_extract(flat, pattern, 1), F.lit("."), F.lit("")))
    for word, digit in ORDINALS.items():
        key = F.replace(key, F.lit(word), F.lit(digit))
    number = lambda i: F.regexp_extract(flat, pattern, i).try_cast("int")
    return F.struct(F.when(key != "", key).alias("key"), number(2).alias("chapter"), number(3).alias("verse"))
