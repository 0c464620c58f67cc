"""The stored index against plain Python, and on empty, null and repeated rows."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from folianta.model import Library
from folianta.operators import index as ix
from folianta.operators import search as se

TEXTS = [
    (1, "Old barns stand\nred barns and old mills", "web-1", "en"),
    (2, "mills of the old town\nit's barn-red", "web-2", "en"),
    (3, "", "web-1", "de"),
    (4, None, None, None),
    (5, "old old old\nbarns", "web-1", "en"),
    (None, "old barns", "web-1", "en"),
    (6, "barns " * 3000 + "\nold barns", "web-2", "de"),
]


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("index")
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, source string, lang string").withColumn("token", F.lit("clash"))
    rows.write.parquet(f"{folder}/documents.parquet")
    return Library(spark, str(folder))


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def columns(lib):
    """Token lists by paragraph, read from the entries."""
    return {r.paragraph_id: [tokens(r[c]) for c in ix.INDEXED] for r in se.index_of(lib).entries.collect()}


def stands_in(phrase, lists):
    return any(one[i : i + len(phrase)] == phrase for one in lists for i in range(len(one)))


@pytest.mark.parametrize("phrases", [[["old"]], [["old", "barns"]], [["old", "old"], ["barns"]], [["barns", "d"]], [["stand", "old"]], [["it", "s"], ["barn", "red"]], [["nowhere"]], [["source", "1"]]])
def test_lookup_equals_brute_force(lib, columns, phrases):
    found = {r.paragraph_id: r for r in ix.lookup(se.index_of(lib), phrases).collect()}
    names = ix.tokens_of(phrases)
    want = {k: v for k, v in columns.items() if any(t in one for one in v for t in names)}
    assert set(found) == set(want)
    for k, lists in want.items():
        assert [found[k][f"tf_{i}"] for i in range(len(names))] == [sum(one.count(t) for one in lists) for t in names]
        assert [found[k][f"match_{i}"] for i in range(len(phrases))] == [stands_in(p, lists) for p in phrases]


def test_scores_follow_the_whole_index(lib, columns):
    index = se.index_of(lib)
    scope = se.scope_of("EN", [1])
    got = {r.paragraph_id: r.score for r in se.bm25(index, ix.lookup(index, [["old"], ["barns"]], scope), ["OLD", "BARNS"]).collect()}
    flat = {k: [t for one in v for t in one] for k, v in columns.items()}
    mean = sum(map(len, flat.values())) / len(flat)

    def score(mine):
        out = 0.0
        for t in ("old", "barns"):
            df = sum(t in x for x in flat.values())
            tf = mine.count(t)
            out += math.log(1 + (len(flat) - df + 0.5) / (df + 0.5)) * tf * (se.K1 + 1) / (tf + se.K1 * (1 - se.B + se.B * len(mine) / mean))
        return out

    assert set(got) == {1000001, 1000002, 5000001, 5000002}
    for k, v in got.items():
        assert v == pytest.approx(score(flat[k]), abs=2e-6)


def test_a_scope_without_sources_finds_nothing(lib):
    assert se.search_free_text(lib, "old barns", 10, sources=[]).count() == 0


def test_an_index_is_built_once_and_anew_for_other_documents(lib, spark, tmp_path):
    first = se.index_of(lib)
    built = []
    again = ix.stored(spark, f"{lib.sf_dir}/documents.parquet", lambda: built.append(1))
    assert again.path == first.path and not built
    spark.createDataFrame(TEXTS[:1], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    other = se.index_of(Library(spark, str(tmp_path)))
    assert other.path != first.path and other.entries.count() == 2


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = Library(spark, str(tmp_path))
    for text in ("old barns", "old", '"old barns"', "old 3", ""):
        assert se.search_free_text(lib, text, 5).count() == 0
