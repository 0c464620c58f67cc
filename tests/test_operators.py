"""Operators on small frames with edge rows."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from folianta.operators import etl, metadata, mutations, quality, songs
from folianta.operators import relational as op
from folianta.operators.search import in_list
from folianta.sources import readers, reports
from folianta.streaming.reservations import reserve


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbering(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([5, 3, 3, 9])], "g int, pos int, detected int")
    assert [r["number"] for r in op.running_number(df, ["g"], "pos", "detected").orderBy("pos").collect()] == [5, 6, 7, 9]
    assert [r["number"] for r in op.fallback_number(df, ["g"], "pos", "detected").orderBy("pos").collect()] == [5, 3, 1, 9]
    nulls = spark.createDataFrame([(1, i, d) for i, d in enumerate([None, 1, None, 2])], "g int, pos int, detected int")
    assert [r["number"] for r in op.fallback_number(nulls, ["g"], "pos", "detected").orderBy("pos").collect()] == [3, 1, 4, 2]


def test_empty_scope_matches_nothing(spark):
    df = spark.range(3)
    assert df.filter(in_list("id", [])).count() == 0 and df.filter(in_list("id", None)).count() == 3


def test_first_child_keeps_parents(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, t string")
    assert rows(op.first_child(parents, children, "k", [F.col("n")]).select("k", "t")) == [(1, "a"), (2, None)]


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "t string")
    assert rows(op.multiset_difference(a, a.limit(0).union(spark.createDataFrame([("x",)], "t string")), ["t"])) == [("x", 1), ("y", 1)]


def test_compare_and_set_is_all_or_none(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    good = spark.createDataFrame([(1, "a", "A")], "k int, old string, new string")
    bad = good.union(spark.createDataFrame([(2, "?", "B")], "k int, old string, new string"))
    assert rows(mutations.compare_and_set(t, good, "k", "v")) == [(1, "A", True), (2, "b", False)]
    assert rows(mutations.compare_and_set(t, bad, "k", "v")) == [(1, "a", False), (2, "b", False)]


def test_upsert_tells_no_ops_apart(spark):
    s = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    i = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert rows(mutations.upsert(s, i, ["k"], ["v"])) == [(1, "a", "kept"), (2, "b", "updated"), (3, None, "inserted")]


def test_reservation_goes_on_where_it_stopped(spark):
    subs = spark.createDataFrame([(i, i != 3, i) for i in range(1, 6)], "subscriber_id int, confirmed boolean, created_at int")
    done = spark.createDataFrame([("t", 1)], "tag string, subscriber_id int")
    first = reserve(subs, done, "t", 2)
    assert rows(first) == [("t", 2), ("t", 4)]
    assert rows(reserve(subs, done.union(first), "t", 2)) == [("t", 5)]


def test_rejoin_keeps_the_first_page(spark):
    data = [(1, 1, 1, None, "a sentence that"), (1, 2, 2, None, "goes on and"), (1, 2, 3, None, "on."), (1, 3, 4, None, "New one"), (1, 4, 5, 7, "numbered")]
    df = spark.createDataFrame(data, "work_id long, page int, pos long, detected int, text string")
    assert [r["text"] for r in etl.rejoin(df).orderBy("pos").collect()] == ["a sentence that goes on and on.", "New one", "numbered"]


def test_packing(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    df = spark.createDataFrame([(text,), ("short",), ("",)], "t string").select(etl.pack_sentences(F.col("t")).alias("p"))
    long, short, empty = (r["p"] for r in df.collect())
    assert " ".join(long) == text and all(len(x) <= 900 for x in long) and short == ["short"] and empty == []


def test_accepted_numbers(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([7, 1, 3, 3, 9, 8])], "work_id long, pos long, detected int")
    assert [r["accepted"] for r in etl.accepted_numbers(df).orderBy("pos").collect()] == [None, 1, 3, None, None, 8]


def test_verdicts(spark):
    texts = ["", "Page 12", "###%%%***", "Chapter Head", "ok", "A proper paragraph with some words.", "Chapter Head"]
    df = spark.createDataFrame([(1, i + 1, i, t) for i, t in enumerate(texts)], "work_id long, number int, page int, text string")
    assert [r["verdict"] for r in etl.verdicts(df).orderBy("number").collect()] == ["too_short", "page_number", "corrupted", "header_footer", "too_short", "accepted", "header_footer"]


def test_songs():
    a, b = "we sing the song together", "and all the people answer"
    assert songs.find_refrain(["first line here", a, b, a, b]) == [a, b, a, b]
    assert songs.find_refrain(["one", "two"]) is None
    assert songs.find_chorus([["verse one goes along here"], [a, b], ["another verse is here"], [a, b]]) == [a, b]
    assert songs.restore_breaks("one two three", ["one", "two  three"]) == "one\ntwo three"
    assert songs.restore_breaks("one two", ["one", "three"]) is None


def test_interleave(spark):
    df = spark.createDataFrame([(["Verse", "Verse", "Chorus"], ["1", "2", "c"]), (["Verse", "Chorus", "Verse"], ["1", "c", "2"])], "k array<string>, t array<string>")
    assert [r[0] for r in df.select(songs.interleaved(F.col("k"), F.col("t"))).collect()] == [["1", "c", "2", "c"], ["1", "c", "2"]]


def test_song_lines(spark):
    cases = [(["a b", "c"], ["a b", "c"], None), (["a b", "c"], [], "missing_section"), (["a b"], ["A, b"], "formatting_only"), (["a", "a", "b"], ["a", "b"], "repeated_removed"), (["a", "b"], ["a"], "missing_trailing"), (["a", "b"], ["a", "x"], "changed_wording")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(quality.compare_lines(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]


def test_alignment():
    kinds = lambda a, b: [o["kind"] for o in quality.align(a, b)]
    assert kinds("a b c", "a b c") == [] and kinds("in to", "into") == ["spacing"] and kinds("a, b", "a b") == ["punct"]
    assert kinds("one two", "one 12 two") == ["number"] and kinds("one two", "one") == ["stored_only"] and kinds("one", "one two") == ["source_only"] and kinds("x y", "x z") == ["diff"]
    assert quality.repair("in to it", "into it") == "into it" and quality.repair("a", "b") is None and quality.repair(None, "b") is None
    assert quality.coverage("a b c d", ["b c"]) == 0.5 and quality.coverage("", None) == 0.0


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text('BOOK,Chapter,verse,TEXT\nJohn,3,16,"He said ""so"", and"\n,1,1,x\nJohn,x,1,t\n')
    assert [(r["text"], r["reason"]) for r in readers.verse_csv(spark, str(tmp_path / "v.csv")).collect()] == [('He said "so", and', None), ("x", "book is missing"), ("t", "chapter is not a positive number")]
    (tmp_path / "c.jsonl").write_text('{"op":"paragraph","id":1,"old":"a","new":"b"}\n{"op":"sections","songId":2,"sections":[{"type":"Verse","label":"1","text":"t"}]}\n')
    assert [r["op"] for r in readers.corrections(spark, str(tmp_path / "c.jsonl")).collect()] == ["paragraph", "sections"]


def test_chapter_files_and_usfm(spark):
    f = spark.createDataFrame([("b_3", "Book 3\nfirst\nsecond\n"), ("b_4", "Book 5\nx\n\ny\n")], "file string, text string")
    assert rows(readers.chapter_files(f).select("file", "verse", "fault"))[:2] == [("b_3", 1, None), ("b_3", 2, None)]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate([r"\c 1", r"\v 1 In the \add first\add* place", r"\q and on", r"\v 2 then"])], "file string, pos int, line string")
    assert rows(readers.usfm_verses(lines).select("chapter", "verse", "text")) == [(1, 1, "In the first place and on"), (1, 2, "then")]


def test_presentation():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = f"<s {a}><a:p><a:r><a:t>Morn</a:t></a:r><a:r><a:t>ing light</a:t></a:r><a:br/><a:r><a:t>over quiet</a:t></a:r><a:tab/><a:r><a:t>roof tops</a:t></a:r></a:p></s>"
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p xmlns:p="p" {r}><p:sldIdLst><p:sldId r:id="r2"/></p:sldIdLst></p>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<R><Relationship Id="r2" Target="slides/slide1.xml"/></R>')
        z.writestr("ppt/slides/slide1.xml", slide)
    assert readers.presentation_lines(buffer.getvalue()) == ["Morning light", "over quiet roof tops", ""]


def test_reports_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"')], "k int, t string")
    reports.write_csv(df, str(tmp_path / "r"))
    assert '"1","a ""b"""' in "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    at = reports.snapshot(df, str(tmp_path / "s"), 1)
    assert reports.snapshot_matches(spark, df, at) and not reports.snapshot_matches(spark, df.union(df), at)


def test_stream_of_events(spark, tmp_path):
    from folianta.streaming.reservations import windowed_counts

    src = spark.createDataFrame([(1, "2024-01-01 00:01:00", "a", 1.0), (2, "2024-01-01 00:02:00", "a", 2.0)], "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [(r["n"], r["total"]) for r in spark.table("counts").collect()] == [(2, 3.0)]


def test_alignment_and_columns_reach_every_paragraph(spark, tmp_path):
    from folianta.plans import catalog

    long = "\n".join(f"word{i} " + "more " * 25 + "end" for i in range(1, 131))
    docs = [(9, long), (2, "one\ntwo\nthree\nfour is a line of some length\nfive")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], columns).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()

    def stored(work, n, text):
        if (work % 7 == 0 and n == 1) or (work % 5 == 0 and n == 3):
            return None
        return " " + text if n == 2 else text[:12] if n == 4 and work % 2 == 0 else "x" + text if n == 5 else text

    want = []
    for work, text in docs:
        for n, t in enumerate(text.split("\n"), 1):
            copy = stored(work, (n - 1) % 8 + 1, t)
            want += [(work, n, o["kind"], o["op"], o["stored"], o["source"]) for o in quality.align(copy, t)] if copy is not None else []
    assert max(n for _, n, *_ in want) > 99
    assert rows(found["k08_token_alignment"](spark, str(tmp_path))) == sorted(want, key=repr)
    words = [(work, c, len(text.split())) for work, text in docs for c in (0, 1)]
    assert rows(found["a05_two_columns"](spark, str(tmp_path)).select("page", "column", "words")) == sorted(words, key=repr)


def test_pages_within_a_budget(spark):
    import random
    import re

    def brute(text, budget):
        units = [" ".join((text or "").split())]
        for pattern in (r"(?<=[.!?]) ", r"(?<=[,;:]) ", " "):
            units = [y for x in units for y in ([x] if len(x) <= budget else re.split(pattern, x)) if y]
        units = [x[i : i + budget] for x in units for i in range(0, len(x), budget)]
        out = []
        for x in units:
            if out and len(out[-1]) + 1 + len(x) <= budget:
                out[-1] += " " + x
            else:
                out.append(x)
        return out

    rng = random.Random(5)
    texts = ["", None, "ab", "x" * 45, *[" ".join("".join(rng.choices("abcü", k=rng.randint(1, 25))) + rng.choice(["", "", ",", ";", ".", "!"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", metadata.pages_within(F.col("t"), 20).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: brute(t, 20) for i, t in enumerate(texts)}


def test_metadata_of_impossible_days_and_nulls(spark):
    names = ["1985-02-30-1400-Oslo", "1985-2-3-1400-Oslo", "199413", "in 1999 again", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(metadata.cascade(F.col("n")).alias("m")).select("m.rule", "m.code", "m.title").collect()
    assert [tuple(r) for r in got] == [
        ("year_month", "CL-1985-02", "Circular Letter - February 1985"), ("meeting", "EF-1985-02-03-OSLO", "Meeting in Oslo - February 3, 1985"),
        ("fallback", "199413", "199413"), ("year", "CL-1999", "Circular Letter - 1999"), ("fallback", "", "Publication"), ("fallback", "", "Publication"),
    ]
    assert spark.createDataFrame([(None,)], "p string").select(metadata.parsed(F.col("p")).alias("m")).select("m.code", "m.year", "m.title").first() == ("", 0, "")


def test_publisher_pages(spark):
    signals = (("all rights",), ("www.x.org",))
    pages = [(["Copyright Notice", "a"], "T", True), (["All rights", "see www.x.org"], "T", True), (["all rights"], "T", False), (["The  Title", "by the press"], "the title", True), (["text", "The press"], "the title", False), ([], "", False), (None, None, False)]
    df = spark.createDataFrame([(i, a, t) for i, (a, t, _) in enumerate(pages)], "i int, ls array<string>, t string")
    assert [r[0] for r in df.orderBy("i").select(metadata.is_publisher_page(F.col("ls"), F.col("t"), signals, "press")).collect()] == [x for *_, x in pages]
