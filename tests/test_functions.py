"""Text, dates, names, references and query analysis on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folianta.functions import analyze as an
from folianta.functions import dates, names, references
from folianta.functions import text as tx
from folianta.operators.highlight import ranges_of
from folianta.operators.search import scatter


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("we came late—\nso we left", "we came late-so we left"),
        ("half an hour– \n  or more", "half an hour-or more"),
        ("a long cor-\nridor", "a long corridor"),
        ("now—then", "now-then"),
        ("one,two ;three", "one, two; three"),
        ("rain fell.Nobody spoke", "rain fell. Nobody spoke"),
        ("Winter ispast, Ispast", "Winter is past, Is past"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_extracted(spark, raw, clean):
    assert one(spark, raw, tx.clean_extracted) == clean


def test_clean_keeps_lines(spark):
    assert one(spark, "a  b\r\n\r\n\r\n\r\nc", lambda c: tx.clean_extracted(c, True)) == "a b\n\nc"


@pytest.mark.parametrize(("raw", "clean"), [("T H E WORD", "THE WORD"), ("W HAT now", "WHAT now"), ("AT HE", "A THE"), ("G LORY", "GLORY"), ("A MAN", "A MAN"), ("A T H E sign", "A THE sign"), ("B L ESSED (I N) it", "BLESSED (IN) it"), ("O LORD, I AM", "O LORD, I AM"), ("D ay", "D ay")])
def test_letter_spacing(spark, raw, clean):
    assert one(spark, raw, tx.clean_display) == clean


@pytest.mark.parametrize("text", ["FÜR DIE", "DE CIÓN DE OS", "CIÓN IN", "STRAßE AM", "DEL Y ES DE", "LAS Y DE", "FU\u0308R DIE", "IL Y EST", "F3028D DE"])
def test_no_letter_spacing_in_capitals(text):
    assert tx.join_letters(text) == text


@pytest.mark.parametrize(("raw", "clean"), [("P RIÈRE", "PRIÈRE"), ("IF Y OU", "IF YOU"), ("É T H E", "É THE"), ("12T HE END", "12THE END")])
def test_letter_spacing_beside_accents(raw, clean):
    assert tx.join_letters(raw) == clean


def test_search_text_keeps_sharp_s(spark):
    assert one(spark, " Straße\t am  See ", tx.search_text) == "STRAßE AM SEE"


def test_normalise_unifies_apostrophes(spark):
    assert one(spark, "Don’t, stop!", tx.normalise_for_search) == "DON'T STOP" == an.normalise("Don't stop")


@pytest.mark.parametrize("n", [239, 240, 241])
def test_preview(spark, n):
    assert one(spark, "x" * n, tx.preview) == ("x" * n if n <= 240 else "x" * 240 + "...")


def test_like_wildcards_are_plain(spark):
    for part, hit in (("%", True), ("_", False), ("\\", True)):
        assert one(spark, "100% \\ Done", lambda c, p=part: tx.contains_folded(c, p)) is hit


def test_search_text_is_cleaned_text(spark):
    assert one(spark, "The ﬁrst ,second;third.End .Next", tx.search_text) == "THE FIRST, SECOND; THIRD. END.NEXT"
    assert one(spark, "a\u00a0b\u200bc “quoted” – left", tx.search_text) == 'A BC "QUOTED" - LEFT'
    assert one(spark, None, tx.search_text) == ""


def test_letters_of_a_text_without_any():
    assert tx.join_letters("") == "" and tx.join_letters("12, 34") == "12, 34"


def test_nfkc(spark):
    assert one(spark, "ﬁne", tx.nfkc) == "fine"
    assert one(spark, None, tx.nfkc) is None


def test_song_key(spark):
    assert one(spark, "Gloire à Dieu – ô!", tx.song_key) == "GLOIRE A DIEU O"


@pytest.mark.parametrize(("text", "n"), [("12. Then", 12), ("7 Then", 7), ("0 Then", None), ("1234 Then", None), ("Then", None), (None, None)])
def test_leading_number(spark, text, n):
    assert one(spark, text, tx.leading_number) == n


def test_snippet(spark):
    text = "a" * 100 + " needle " + "b" * 200
    out = one(spark, text, lambda c: tx.snippet(c, "Needle"))
    assert out.startswith("...") and out.endswith("...") and "needle" in out


@pytest.mark.parametrize(("raw", "mail"), [(" Me@Example.ORG ", "me@example.org"), ("no at sign", None), ("a@b", None)])
def test_email(spark, raw, mail):
    assert one(spark, raw, tx.email_of) == mail


@pytest.mark.parametrize(("code", "date"), [("47-0412", "1947-04-12"), ("29-0101", "2029-01-01"), ("47-1350", None), ("x", None)])
def test_date_of_code(spark, code, date):
    assert str(one(spark, code, dates.date_of_code)) == str(date)


def test_paths(spark):
    assert one(spark, r"C:\Lib\1998\Talk (2).pdf", names.base_name) == "Talk"
    assert one(spark, "/lib/1998/talk.pdf", dates.year_of_path) == 1998
    assert one(spark, "/lib/french/talk.pdf", names.language_of_path) == "fr"
    assert one(spark, "Refrain 2:", names.section_type) == "Chorus"


@pytest.mark.parametrize(
    ("text", "place"),
    [("Romans 12 1", (45, 12, 1)), ("Rom 12 1", (45, 12, 1)), ("Romans 12", (45, 12, None)), ("Jn 3 16", (43, 3, 16)), ("Ps 23", (19, 23, None)), ("1 Samuel 2:2", (9, 2, 2)), ("Genèse 1:1", (1, 1, 1)), ("Yohana 3:16", (43, 3, 16))],
)
def test_references(text, place):
    r = references.parse_reference(text)
    assert r.valid and (r.book_id, r.chapter, r.verse) == place


def test_bad_references():
    assert "unknown" in references.parse_reference("Nowhere 3:16").error
    assert not references.parse_reference("John 0").valid
    assert not references.parse_reference("just words").valid


def test_navigation():
    assert references.navigate("5:2", current_book=43) == references.Target(43, 5, 2)
    assert references.navigate("ro", None).book_id == 45
    assert references.navigate("zzz top", None).keyword == "zzz top"
    assert len(references.BOOKS) == len(references.SHORT) == len(references.FRENCH) == len(references.SWAHILI) == 66


def test_query_analysis():
    assert an.paragraph_lookup("faith 12") == an.Lookup("faith", 12)
    assert an.paragraph_lookup("47-0412") is None and an.paragraph_lookup("faith 0") is None
    # a month and a year are taken as a lookup: it is tried first
    assert an.paragraph_lookup("December 2020") == an.Lookup("December", 2020)
    assert an.date_intent("2019 march") == an.DateIntent("march", 2019, 2019)
    assert an.date_intent("june 19 spirit") == an.DateIntent("june", 1900, 1999)
    assert an.date_intent("june 31 spirit") is None
    assert an.exact_phrase("“had said”") == "had said" and an.exact_phrase('"open') is None
    assert an.scope(9, [2, 3]) == [] and an.scope(None, None) is None and an.scope(None, []) == []
    assert an.index_terms("don't") == ["don", "t"]


def test_scatter():
    assert scatter("A B C", ["A", "C"]) == {"score": 100_004, "occurrences": 1}
    assert scatter("C B A", ["A", "C"]) == {"score": 200_004, "occurrences": 1}
    assert scatter("A B", ["A", "C"]) is None


def test_highlight():
    cut = lambda t, q: [t[r["start"] : r["start"] + r["length"]] for r in ranges_of(t, q)]
    assert cut("Then Jesus had said so", "jesus had said") == ["Jesus had said"]
    assert cut("Jesus once had, he said", "jesus had said") == ["Jesus", "had", "said"]
    assert cut("I don’t know", "don't") == ["don’t"]
    assert cut("nothing here", '"jesus had"') == []
