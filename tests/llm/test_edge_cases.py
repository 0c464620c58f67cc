"""Every operator on nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import pytest

from folianta.llm import chat, decontam, exactdedup, licenses, mixing, neardup, pii, sharding, toxicity, warc

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, owner string, weight double, size int, hash string"
ROWS = [
    (1, "One two three four five six seven", "en", "a"),
    (1, "One two three four five six seven", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "One  two three four five six seven", None, "a"),
    (4, LONG, "de", "b"),
    (5, LONG + " end", "de", "b"),
    (6, " \t\n ", "fr", None),
    (None, None, "en", "c"),
    (7, "mail me@example.org or +1 (017) 555-0199", "en", "c"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None, 9, "k", "o", 1.5, 3, "h") for r in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (3, None, 1), (4, 1, None), (None, 1, 1), (5, 0, 0), (5, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((0, "x y z"), (1, None), (None, LONG[:400]))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "licenses": lambda s, d: licenses.license_report(d),
    "sharding": lambda s, d: sharding.shard_documents(d, 4, 64),
    "toxicity": lambda s, d: toxicity.score_documents(d, toxicity.train(d, labels(s))),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "mixing": lambda s, d: mixing.mix(d),
    "pii": lambda s, d: pii.personal_data(d),
    "decontam": lambda s, d: decontam.decontaminate(d, bench(s)),
    "exactdedup": lambda s, d: exactdedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, frame(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark).limit(0)).collect() == []


@pytest.mark.parametrize(
    "stage",
    [
        lambda s, d: toxicity.drop_toxic(d, toxicity.train(d, labels(s))),
        lambda s, d: neardup.keep_one_of_each(d),
        lambda s, d: decontam.drop_contaminated(d, bench(s)),
        lambda s, d: mixing.sample(d),
    ],
)
def test_stages_keep_columns(spark, stage):
    d = frame(spark)
    assert stage(spark, d).columns == d.columns
    stage(spark, d).collect()
    assert stage(spark, d.limit(0)).collect() == []


def test_exact_dedup_groups(spark):
    out = exactdedup.exact_dedup(frame(spark))
    by = {(r["doc_id"], r["group_size"], r["keep_id"], r["kept"]) for r in out.collect()}
    # the null id loses to 1; null, empty and the second null are one group, blank text is its own
    assert {(1, 3, 1, True), (None, 3, 1, False), (2, 3, 2, True), (3, 3, 2, False), (None, 3, 2, False), (6, 1, 6, True)} <= by


def test_near_duplicates_groups(spark):
    out = {(r["doc_id"], r["class_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark)).collect()}
    assert {(1, 1, True), (None, 1, False), (4, 4, True), (5, 4, False), (2, 2, True), (6, 2, False), (7, 7, True)} <= out


def test_all_ids_null(spark):
    d = frame(spark, [(None, "same text here", "en", "a")] * 3)
    assert [(r["class_id"], r["kept"]) for r in neardup.near_duplicates(d).collect()] == [(None, True)] * 3
    assert [(r["keep_id"], r["kept"]) for r in exactdedup.exact_dedup(d).collect()] == [(None, True)] * 3


def test_toxicity_without_labels_or_one_class(spark):
    d = frame(spark)
    for marks in ([], [(1, 1, 0), (4, 1, 0)]):
        scores = {r["score"] for r in toxicity.score_documents(d, toxicity.train(d, labels(spark, marks))).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_decontamination_without_benchmark(spark):
    assert not any(r["contaminated"] for r in decontam.decontaminate(frame(spark), bench(spark).limit(0)).collect())


PAGES = "page_id long, url string, html string, payload string, owner long, digest string"


def test_warc_edges(spark):
    body = "é" * 60
    rows = [(3, "http://a b/\n", body), (2, None, body), (2, "u", body), (None, "u", body), (4, "u", None), (5, "u", "tiny"), (6, "u", "tiny"), (7, "u", "<p>" + "x" * 300_000)]
    out = warc.archived(spark.createDataFrame([(*r, "p", 1, "d") for r in rows], PAGES))
    got = sorted(((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out.collect()), key=repr)
    assert got == sorted([("3", 120, "revisit", 2), ("2", 120, "response", None), ("2", 120, "response", None), ("None", 120, "response", None), ("4", 0, "response", None), ("5", 4, "response", None), ("6", 4, "response", None), ("7", 300_003, "response", None)], key=repr)
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, ids string, part int, mask string"
    rows = [(1, 1, "assistant", "b ### x"), (1, 0, "user", None), (1, None, None, "n"), (1, 1, "assistant", "b ### x"), (None, 0, "tool", "\\</turn>"), (2, 0, "odd\nrole ### ", LONG)]
    d = spark.createDataFrame([(*r, "i", 1, "m") for r in rows], schema)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(d, part_tokens=50)).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 4, None: 1, 2: 1}
    assert got[1]["loss_chars"] == 14 and got[2]["loss_chars"] == 0
    assert chat.read_back(chat.format_conversations(d.limit(0))).collect() == []
