"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest
from parity import check, duck

from folianta.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    check(spark, con, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()


def test_containment_wherever_words_begin_and_end(spark, tmp_path):
    """Line breaks among an item's first words, matches from within a word to within a word, short, empty, null and repeated items."""
    import duckdb

    docs = [(1, "Here.\nIs a text of\nsome words.\n"), (2, "There.\nIs a text of\nsome words"), (2, "other. Is a text"), (3, "a b"), (4, ""), (5, None)]
    items = [(1, "ere.\nIs a text of\nsome wor"), (2, "\nIs a text"), (3, "here. Is a"), (4, "b"), (5, ""), (6, None), (7, "of\nsome"), (7, "a b"), (8, "Is a text of some words"), (9, ". Is a tex")]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    check(spark, con, str(tmp_path), QUERIES["k11_containment"], SQL["k11_containment"])


@pytest.mark.parametrize("name", ["b02_materialised_index", "h03_search_text"])
def test_search_text_of_passages_in_capitals(spark, tmp_path, name):
    """Items of the benchmark in capitals, as shouted documents hold them, in four languages."""
    import duckdb

    items = ["GA ÑBOCIÓN CIÓNJAC", "ADOEZAR, Y DE ÑOS DEL Y ES DE", "VERPF FÜR ERLICHSCHÜ", "OU!! AN ÉONQUEÊ AIVI AI, LES. LAÈÈLERÉ", "THE HEATOU ONONAT TO TO THE ANOR"]
    rows = [(i, t, "en", "src1") for i, t in enumerate(items)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    check(spark, con, str(tmp_path), QUERIES[name], SQL[name])


def test_names_and_oracles_belong_together():
    assert set(SQL) <= set(QUERIES)


def test_entry_works_without_the_optional_subpackage(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def no_llm(name, *args, **kwargs):
        if name.startswith("folianta.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith("folianta.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", no_llm)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
