"""The methods against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from parity import check, duck
from pyspark.sql import functions as F

from folianta.llm import chat, decontam, entry, exactdedup, licenses, mixing, neardup, pii, sharding, toxicity, warc, wordkernel
from folianta.llm.components import components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return {d["doc_id"]: d["text"] or "" for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    check(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])


# ---- kernels


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_a_regex(texts):
    found = wordkernel.words(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        want = re.findall(rb"[0-9a-z\x80-\xff]+", pa.compute.utf8_lower(pa.scalar(t)).as_py().encode())
        assert len(found.of(i)) == len(want)
        alone = [int(wordkernel.words(pa.array([w.decode()], pa.large_string())).hashes[0]) for w in want if w.isascii()]
        assert set(alone) <= {int(h) for h in found.of(i)}


@given(st.lists(st.binary(max_size=12), max_size=30), st.randoms())
@settings(max_examples=200, deadline=None)
def test_trie_counts_and_owners(keys, rng):
    trie, want = exactdedup.PatriciaTrie(), {}
    for i, k in enumerate(keys):
        trie.insert(k, i)
        first, n = want.get(k, (i, 0))
        want[k] = (first, n + 1)
    assert {k: (o, n) for k, o, n in trie.drain()} == want
    # in byte order, finished subtrees leave as the keys pass
    trie, got, last = exactdedup.PatriciaTrie(), [], None
    for k, i in sorted((k, i) for i, k in enumerate(keys)):
        if k != last:
            got += trie.finished(k)
            last = k
        trie.insert(k, i)
    got += trie.drain()
    assert len(got) == len(want) and {k: (o, n) for k, o, n in got} == want


def test_trie_spills_lose_nothing():
    trie, out = exactdedup.PatriciaTrie(), []
    for i in range(2000):
        trie.insert(hashlib.md5(str(i % 500).encode()).digest(), i)
        while trie.weight > 2000:
            out += trie.spill()
    out += trie.drain()
    assert sum(n for *_, n in out) == 2000 and len({k for k, *_ in out}) == 500


def test_small_trie_gives_the_same_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(exactdedup.exact_dedup(docs, trie_bytes=1 << 16)) == rows(exactdedup.exact_dedup(docs))


# ---- near duplicates


def test_samples_agree_as_similarity_says():
    rng = np.random.default_rng(1)
    agree, true = [], []
    for _ in range(200):
        ids = np.unique(rng.integers(0, 2**32, 300, dtype=np.uint32))
        w = rng.uniform(0.5, 8, len(ids)).astype(np.float32)
        keep = rng.random(len(ids)) < 0.85
        other = np.where(rng.random(len(ids)) < 0.2, w * np.float32(1.4), w)
        agree.append((neardup.icws(ids, w) == neardup.icws(ids[keep], other[keep])).mean())
        true.append(neardup.weighted_jaccard((ids, w), (ids[keep], other[keep])))
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def brute_classes(documents: dict[int, str], least: int = 1) -> dict[int, int]:
    """Links of all pairs by true document frequencies, those below ``least`` taken as ``least``."""
    ids = sorted(documents)
    found = wordkernel.words(pa.array([documents[i] for i in ids], pa.large_string()))
    sets = [neardup.counted(neardup.ids_of(found.of(k))) for k in range(len(ids))]
    nodes = [neardup.node_of(found.of(k)) for k in range(len(ids))]
    every, counts = np.unique(np.concatenate([s[0] for s in sets]), return_counts=True)
    idf = neardup.idf_of(every, counts, len(ids), least)
    weighted = [(a, neardup.weights(a, tf, idf)) for a, tf in sets]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if nodes[i] == nodes[j] or (len(sets[i][0]) and len(sets[j][0]) and neardup.weighted_jaccard(weighted[i], weighted[j]) >= 0.8):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def variants(seed: int = 5) -> dict[int, str]:
    """Chains of edited copies around 0.8, exact copies, and others."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out, n = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(10):
            out[n] = " ".join(base)
            n += 1
            if rng.random() < 0.7:
                base = list(base)
                for _ in range(rng.choice([1, 1, 2, 5])):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
    return out


def test_classes_are_those_of_all_pairs(spark):
    texts = variants()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(texts)


def test_buckets_too_large_for_a_task(spark):
    """They take further rounds with a new leader, with the same result."""
    words = [f"w{i}" for i in range(90)]
    texts = {}
    for i in range(3):  # neighbours are linked, others aren't
        texts[i] = " ".join(words)
        words[30 * i + 4] = f"x{i}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, local_bytes=0).collect()} == brute_classes(texts)


def test_document_frequencies_are_true(spark):
    texts = [*variants().values(), "a b", "a b", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = wordkernel.words(pa.array(texts, pa.large_string()))
    per_text = [neardup.counted(neardup.ids_of(found.of(k)))[0] for k in range(len(texts))]
    ids, counts = np.unique(np.concatenate(per_text), return_counts=True)
    for frequent in (1 << 22, 500):  # the second keeps only shingles of several texts
        got = neardup.document_frequencies(df, frequent)
        least = -(-int(counts.sum()) // frequent)
        want = neardup.idf_of(ids, counts, len(texts), least)
        assert len(got.keys) <= frequent and np.array_equal(got.keys, want.keys)
        assert np.allclose(got.of(ids), want.of(ids)) and got.of(ids).min() >= 1


def test_classes_with_shared_weights_of_rare_shingles(spark):
    texts = variants(8)
    total = sum(len(set(neardup.ids_of(wordkernel.words(pa.array([t])).hashes))) for t in texts.values())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, frequent=total // 3).collect()}
    assert got == brute_classes(texts, -(-total // (total // 3)))


def test_near_copies_in_larger_groups(spark):
    """However many copies there are, one with two edits in 100 words (0.81 by counts alone) is linked to its original."""
    texts = {0: " ".join(f"w{i}" for i in range(100))}
    for n in range(1, 81):
        words = texts[0].split()
        words[5 + n], words[(5 + n + 40) % 90 + 5] = f"a{n}", f"b{n}"
        texts[n] = " ".join(words)
    texts |= {100 + n: " ".join(f"x{n}y{i}" for i in range(100)) for n in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(texts) == {i: 0 if i < 100 else i for i in texts}


def test_frequent_passages_weigh_less_than_their_text():
    idf = neardup.Idf(np.array([1, 2, 3, 4], np.uint32), np.array([2, 2, 5, 5], np.float32), np.float32(9))
    ones = np.ones(6, np.uint32)
    assert neardup.weights(np.array([1, 2, 3, 4, 8, 9], np.uint32), ones, idf).tolist() == [2, 2, 5, 5, 5, 5]
    assert neardup.weights(np.array([1, 9], np.uint32), np.array([1, 3], np.uint32), idf).tolist() == [2, 27]
    assert neardup.weights(np.zeros(0, np.uint32), np.zeros(0, np.uint32), idf).tolist() == []


def test_very_long_texts(spark):
    """Texts of a million words: weights stay positive, unlike texts have other sketches, near ones meet."""
    rng = np.random.default_rng(3)
    words = lambda: rng.integers(0, 50_000, 1_000_000)
    a, b = words(), words()
    near = a.copy()
    near[rng.integers(0, len(a), 2_000)] = 1
    texts = {i: " ".join(map(str, x)) for i, x in enumerate((a, b, near))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    idf = neardup.document_frequencies(df)
    sets = [neardup.counted(neardup.ids_of(wordkernel.words(pa.array([t])).hashes)) for t in texts.values()]
    weighted = [neardup.weights(ids, tf, idf) for ids, tf in sets]
    assert all(np.isfinite(w).all() and w.min() >= 1 for w in weighted)
    one, two = (neardup.icws(ids[:40_000], w[:40_000]) for (ids, _), w in zip(sets[:2], weighted, strict=False))
    assert (one == two).mean() < 0.1
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("local_bytes", [1 << 14, 1 << 30])
def test_links_of_real_texts(spark, local_bytes):
    """On the driver's documents the classes are those of all pairs, whichever way buckets are finished."""
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), local_bytes=local_bytes).collect()}
    assert got == brute_classes(texts)


def test_one_row_of_each_stays(spark):
    rows = [(1, "same words in this text here")] * 3 + [(2, "same words in this text here"), (None, "same words in this text here"), (1, "another text of some six words"), (None, "lone"), (None, "lone")]
    out = neardup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, rows[0][1]), (1, rows[5][1]), (None, "lone")], key=repr)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    for small in (10**6, 0):
        got = {r["node"]: r["root"] for r in components(df, "a", "b", small).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


# ---- decontamination


def test_rows_are_judged_by_their_own_texts(spark):
    item = " ".join(f"b{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item), (2, "z " + item), (None, "q " * 30), (3, None)], "item_id long, text string")
    rows = [(None, "x " + item), (None, "clean text"), (5, item), (5, "other words"), (5, item), (6, None), (7, "q " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, decontam.drop_contaminated(docs, benchmark).collect()), key=repr) == sorted([rows[1], rows[3], rows[5], rows[6]], key=repr)
    out = sorted(((r["doc_id"], r["items"]) for r in decontam.decontaminate(docs, benchmark).collect()), key=repr)
    assert out == sorted([(None, "1,2"), (None, ""), (5, "1,2"), (5, ""), (5, "1,2"), (6, ""), (7, "")], key=repr)


def test_substitutions_up_to_the_limit(spark):
    rng = random.Random(3)
    item = [f"b{i}" for i in range(30)]
    docs, want = [], {}
    for i in range(120):
        k = rng.randrange(0, 6)
        window = item[8:21]
        for at in rng.sample(range(13), k):
            window[at] = f"x{i}{at}"
        docs.append((i, " ".join([f"p{i}"] * 20 + window + [f"s{i}"] * 20)))
        want[i] = k <= decontam.MISSES
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"]: r["contaminated"] for r in got.collect()} == want


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_rule(t: str) -> str:
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [("email", *m.span()) for m in EMAIL.finditer(t)]
    spans += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    spans += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@given(st.text(alphabet="ab.@-+_%1234 567890()\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_rules_equal_their_patterns(text):
    spans = pii.base_spans(text)
    assert ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k]) == base_by_rule(text)


def test_base_spans_of_documents(spark, documents):
    for r in entry.op6_pii(spark, SF).collect():
        want = base_by_rule(documents[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"Please note. Contact id: user{i}@example.org today") for i in range(12)]
    rows += [(50, "Contact id: AB-99812-X please"), (51, "Order number AB-11111-Y here"), (52, "on page 123456 we see")]
    # found identifiers make a second pattern reliable in the next round
    rows += [(60 + i, f"Contact id: K{i}-55501 x") for i in range(6)] + [(80 + i, f"member code: K{i}-55501 x") for i in range(6)] + [(90, "member code: ZZ-777123 x")]
    out = {r["doc_id"]: (r["n_id"], r["spans"]) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    cut = lambda i: [text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i][1].split(",") if s) if k == "id"]
    assert cut(50) == ["AB-99812-X"] and cut(90) == ["ZZ-777123"]
    assert out[51][0] == 0 and out[52][0] == 0 and out[0][0] == 0


def test_bootstrap_by_one_word_either_side_and_any_length(spark):
    words = ["oak", "elm", "ash", "fir", "yew", "bay", "fig", "nut"]
    rows = [(i, f"{words[i % 8]}{'x' * i} email: user{i}@example.org") for i in range(40)] + [(100, "Bob email: MEMBER-N-55"), (101, "Cat email:\nDE89 3704 0044 0532 0130 00 end"), (102, "Dan email: " + "k9" * 200)]
    rows += [(200 + i, f"call +1 555 01{i:02d} 77{i:02d} anytime {words[i % 8]}") for i in range(20)] + [(230, "go M-77/2 anytime now"), (231, "go M-77/3 sometime now")]
    rows += [(300 + i, f'key{"q" * i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {words[i % 8]}') for i in range(20)] + [(330, hashlib.sha1(b"file").hexdigest() + " is the sum"), (331, 'token = "short_key_1"')]
    # a common word before seeds of several kinds is no label
    rows += [(400 + i, f"see the {x}") for i, x in enumerate(["a1@example.org", "b2@example.org", "10.0.0.1", "10.0.0.2", "+1 555 123 4567", "+1 555 123 4568", "4111 1111 1111 1111"])] + [(420, "see the A-113")]
    text = dict(rows)
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = lambda i: [text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i].split(",") if s) if k == "id"]
    assert found(100) == ["MEMBER-N-55"] and found(101) == ["DE89 3704 0044 0532 0130 00"] and found(102) == ["k9" * 200]
    assert found(230) == ["M-77/2"] and found(231) == []
    assert found(300) == [hashlib.sha1(b"0").hexdigest()] and found(330) == [] and found(331) == ["short_key_1"]
    assert found(420) == []


def test_bootstrap_on_documents(spark):
    """Of the secrets that the driver planted behind a label, all are found, and nothing else is named."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marked = docs.filter("text rlike '[Tt][Oo][Kk][Ee][Nn] = '").union(docs.filter("doc_id % 9 = 0")).dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] or "" for r in marked.collect()}
    named = {(r["doc_id"], int(a), int(b)) for r in pii.personal_data(marked).collect() for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "id"}
    true = {(i, m.start(1), m.end(1)) for i, t in text.items() for m in re.finditer('token = "([0-9a-f]{40})"', t, re.I)}
    assert len(true) > 100 and len(named & true) >= 0.95 * len(true) and len(named & true) >= 0.95 * len(named)


# ---- toxicity


def auc(score, label):
    ranks = np.empty(len(score))
    values, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[inverse]
    ones = label.sum()
    return (ranks[label == 1].mean() - (ones + 1) / 2) / (len(label) - ones)


def test_held_out_accuracy(spark):
    """On check_s: an AUC of 0.99 and more, hardly a clean row rejected, nine toxic ones in ten caught."""
    data = "/root/testdata/check_s"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    few = labels.filter("doc_id % 4 = 1 OR doc_id < 20000")
    scored = toxicity.score_documents(docs.join(few.select("doc_id"), "doc_id", "left_semi"), toxicity.train(docs, labels)).join(few, "doc_id").filter("held_out AND toxic IS NOT NULL")
    s = scored.toPandas()
    clean, toxic = s[s.toxic == 0], s[s.toxic == 1]
    assert (clean.predicted == 1).mean() <= 0.005 and (toxic.predicted == 1).mean() >= 0.9
    assert auc(s.score.to_numpy(), s.toxic.to_numpy()) >= 0.99


def pair_texts(seed, n, label, share=0.4, noise=2000, length=20):
    """Texts with terms 1 and 2 each in a share of them, among others, labelled by both."""
    rng = np.random.default_rng(seed)
    rows, terms, labels, kind = [], [], [], []
    for i in range(n):
        a, b = rng.random() < share, rng.random() < share
        words = ({1} if a else set()) | ({2} if b else set()) | {int(x) for x in rng.integers(10, 10 + noise, length)}
        rows += [i] * len(words)
        terms += sorted(words)
        labels.append(float(label(a, b, rng)))
        kind.append(2 * a + b)
    return np.array(rows), np.array(terms), np.array(labels), np.array(kind)


def accuracy(model, made):
    rows, terms, labels, _ = made
    at = model.place[terms]
    return ((model.scores(rows[at >= 0], at[at >= 0], len(labels)) >= 0.5) == (labels == 1)).mean()


def additive(made, test):
    """Logistic regression on the two terms: what weights without interactions can reach."""
    x = lambda kind: np.stack([np.ones(len(kind)), kind // 2, kind % 2], 1)
    w = np.zeros(3)
    for _ in range(500):
        w -= 2 * x(made[3]).T @ (1 / (1 + np.exp(-x(made[3]) @ w)) - made[2]) / len(made[2])
    return ((x(test[3]) @ w >= 0) == (test[2] == 1)).mean()


def test_pairs_that_additive_weights_miss():
    """Toxic where one of two terms stands without the other, in half of all texts each: neither tells anything alone."""
    xor = lambda a, b, rng: a != b
    made, test = pair_texts(0, 8000, xor, 0.5), pair_texts(1, 2000, xor, 0.5)
    assert additive(made, test) < 0.6
    assert accuracy(toxicity.fit(*made[:3]), test) > 0.97


def test_pairs_of_terms_that_are_neutral_alone():
    """Three in ten texts are toxic, with either term or without; all that have both."""
    label = lambda a, b, rng: rng.random() < (1 if a and b else 0 if a or b else 3 / 7)
    made = pair_texts(0, 8000, label, 0.3)
    for t in (1, 2):
        held = made[2][made[0][made[1] == t]]
        assert abs(held.mean() - made[2].mean()) < toxicity.SCREEN * np.sqrt(made[2].var() / len(held))
    model = toxicity.fit(*made[:3])
    rows, terms, _, kind = pair_texts(1, 3000, label, 0.3)
    at = model.place[terms]
    score = model.scores(rows[at >= 0], at[at >= 0], 3000)
    assert (score[kind == 3] >= 0.5).mean() > 0.95
    assert (score[(kind == 1) | (kind == 2)] < toxicity.THRESHOLD).mean() > 0.95
    chance = np.random.default_rng(5).permutation(made[2])
    assert (toxicity.fit(made[0], made[1], chance).place >= 0).sum() <= 3


def test_scores_by_the_definition(spark):
    """The registered query's scores, from the sum over all terms and pairs of terms of a few whole texts."""
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in entry.op3_toxicity(spark, data).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        z = model.bias
        terms = sorted({int(h) % toxicity.DIMENSIONS for h in wordkernel.words(pa.array([text])).hashes})
        places = [int(model.place[t]) for t in terms if model.place[t] >= 0]
        z += sum(model.linear[i] for i in places) + sum(float(model.vectors[i] @ model.vectors[j]) for k, i in enumerate(places) for j in places[:k])
        want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r = got[doc_id]
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_training_sample_is_bounded_in_bytes(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda r, t, y: seen.append((len(t), len(y))) or real(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    try:
        toxicity.train(docs, labels)
        toxicity.train(docs, labels, max_bytes=20_000)
    finally:
        toxicity.fit = real
    assert 4 * seen[0][0] > 200_000 and 0 < 4 * seen[1][0] <= 20_000 and seen[1][1] > 5


def test_held_out_rows_never_train(spark):
    ids = spark.range(2000).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)


# ---- sharding


def test_law_of_bytes(spark, documents):
    out = entry.op2_sharding(spark, SF).toPandas()
    assert len(out) == len(documents) and set(out.shard) <= set(range(40))
    assert (out["size"] == [len(documents[d].encode()) + 16 for d in out.doc_id]).all()
    assert (out.text_crc32 == [zlib.crc32(documents[d].encode()) for d in out.doc_id]).all()
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= out["size"].max()
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_rows_without_ids_and_repeated_rows_spread(spark):
    rows = [(None, f"some text {i % 3}") for i in range(400)] + [(i, f"text of {i}") for i in range(400)] + [(7, f"version {i}") for i in range(300)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(loads) == 40 and loads.max() - loads.min() <= 2 * out["size"].max()


def test_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "maps")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 as int)) AS text")
    run = lambda d, shards=8: {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard_documents(d, shards, 512, path).collect()}
    first = run(docs)
    assert {v for _, v in first.values()} == {1} and run(docs) == first
    grown = run(docs.union(spark.range(3000, 3400).selectExpr("id", "repeat('y', 400)")))
    moved = sum(grown[i][0] != s for i, (s, _) in first.items())
    assert {v for _, v in grown.values()} == {2} and 0 < moved < 0.3 * len(first)
    more = run(docs, 9)
    assert {v for _, v in more.values()} == {3} and {s for s, _ in more.values()} == set(range(9))
    assert [sharding.SlotMap.load(spark, path, v).version for v in (1, 2, 3)] == [1, 2, 3]


def test_rebalancing_moves_little(spark, tmp_path):
    rng = random.Random(1)
    loads = {i: rng.randrange(50, 150) for i in range(512)}
    first = sharding.SlotMap.build(loads, 512, 8)
    grown = first.rebalance(loads, 9)
    assert grown.version == 2 and grown.shards == 9 and len(grown.moved) <= 512 / 9 * 1.3
    assert all(a == b for i, (a, b) in enumerate(zip(first.shard_of, grown.shard_of, strict=True)) if i not in grown.moved)
    shrunk = grown.rebalance(loads, 7)
    assert max(shrunk.shard_of) == 6 and max(shrunk.loads(loads)) <= sum(loads.values()) / 7 * 1.02
    same = first.rebalance(loads)
    assert same.moved == ()
    for m in (first, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


# ---- mixing


def test_marginals_hold(spark):
    rows = [(i, ["a", "b", "c"][min(2, i % 5)], ["en", "de"][i % 3 == 0], "word " * (1 + i % 40)) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    want = {"a": 0.5, "b": 0.3, "c": 0.2}
    targets = {"source": spark.createDataFrame(list(want.items()), "source string, share double")}
    out = mixing.mix(d, targets, sweeps=20).toPandas()
    out["mass"] = out.tokens * out.probability * out.weight
    share = out.groupby("source").mass.sum() / out.mass.sum()
    assert all(abs(share[s] - w) < 0.003 for s, w in want.items())
    assert abs(out.mass.sum() / out.tokens.sum() - mixing.KEEP) < 0.01
    drawn = out[out.sampled]
    assert abs((drawn.tokens * 1.0).sum() / (out.tokens * out.probability).sum() - 1) < 0.1


def test_drawn_sample_meets_every_marginal(spark):
    """On the driver's documents: the expected sample to four digits, the drawn one to a few deviations, on all three margins."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mix(docs).toPandas()
    rate = out.probability * out.weight
    drawn = mixing.described(mixing.sample(docs)).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")).toPandas()
    assert drawn.tokens.sum() == (out.tokens * out.copies).sum()
    for d in mixing.DIMENSIONS:
        have = out[out.tokens > 0].groupby(d).tokens.sum()
        want = have**mixing.TEMPER / (have**mixing.TEMPER).sum()
        expected = (out.tokens * rate).groupby(out[d]).sum()[want.index] / (out.tokens * rate)[out.tokens > 0].sum()
        assert abs(expected - want).max() < 1e-4
        part = rate - np.floor(rate)
        deviation = np.sqrt((out.tokens**2 * part * (1 - part)).groupby(out[d]).sum()[want.index]) / (out.tokens * rate).sum()
        got = drawn.groupby(d).tokens.sum().reindex(want.index).fillna(0) / drawn.tokens.sum()
        assert (abs(got - want) <= 5 * deviation + 0.002).all(), (d, got, want)


# ---- licences


def test_dice_and_bounds():
    lib = licenses.Library.of((("L", "notice", "one two three four five six"),))
    found = lambda t: licenses.licenses_in(pa.array([t], pa.large_string()), lib)[0]
    assert found("Intro.\nOne, two: three four five six!\nmore")["L"] == (1.0, "line")
    assert found("one two three four five seven")["L"][0] == pytest.approx(0.8)
    assert found("one two three four") == {} and found("") == {}
    split = found("x\n\none two three\nfour five six\n\ny")
    assert split["L"] == (1.0, "block")


def test_licences_inside_longer_texts():
    lib = licenses.Library.of()
    found = lambda t: licenses.licenses_in(pa.array(["", t, "x"], pa.large_string()), lib)[1]
    mit = next(t for n, form, t in licenses.TEMPLATES if n == "MIT" and form == "text")
    code = "\n".join(f"def f{i}(a, b): return a + b * {i}" for i in range(400))
    blocks = mit.replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    assert blocks.count("\n\n") == 2
    assert found(f"Copyright 2020 A. Person\n\n{blocks}\n\n{code}") == {"MIT": (1.0, "window")}
    assert found(f"{code}\n\n{blocks}\n\n{code}") == {"MIT": (1.0, "window")}
    for line in ("Licensed under the MIT License. See LICENSE for details.", "This library is licensed under the MIT License."):
        assert found(line)["MIT"] == (1.0, "window")
    assert found(code) == {}
    # words that fit one licence better aren't another's
    assert set(found("See the file. This gift is licensed under CC BY-NC 4.0 as you will find.")) == {"CC-BY-NC-4.0"}


@given(st.lists(st.integers(0, 9), min_size=2, max_size=40), st.sets(st.integers(0, 9), min_size=2, max_size=6))
@settings(max_examples=200, deadline=None)
def test_best_window_is_that_of_all_windows(text, template):
    grams, high = np.array(text, np.uint64), int(len(template) * 1.5)
    want = 0.0
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            own = set(text[i:j])
            if len(own) <= high:
                want = max(want, 2 * len(own & template) / (len(own) + len(template)))
    got = licenses.best_window(grams, np.isin(grams, list(template)), len(template), high)
    assert got[0] == pytest.approx(want)


# ---- WARC


def test_reader_pushes_filters_and_skips_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<p>{i % 4}</p>" + "y" * 200) for i in range(60)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_pages(pages, path)
    df = spark.read.format("warc").option("part_bytes", 500).load(path)
    assert df.rdd.getNumPartitions() >= 1
    some = df.filter("record_type = 'response' AND target_uri LIKE 'http://h1%'").select("record_id", "payload")
    assert {r["record_id"].rsplit(":", 1)[1] for r in some.collect()} == {"1"}
    assert df.filter("record_type = 'revisit'").count() == 56
    reader = warc.WarcReader(path, True, 1 << 20)
    from pyspark.sql import datasource as ds

    left = list(reader.pushFilters([ds.EqualTo(("record_type",), "response"), ds.GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and len(reader.filters) == 1
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload IS NOT NULL").count() == 0


@pytest.mark.parametrize("kind", ["plain", "gzip", "sl"])
def test_foreign_archives(spark, tmp_path, kind):
    import gzip

    recs = [warc.record({"record_id": f"urn:x:{i}", "record_type": "response", "target_uri": f"http://x/{i}", "refers_to": None, "payload_digest": None, "payload_length": 5000 * i}, b"z" * 5000 * i) for i in range(4)]
    pack = {"plain": lambda r: r, "gzip": gzip.compress, "sl": warc.gzip_member}[kind]
    name = "a.warc" if kind == "plain" else "a.warc.gz"
    (tmp_path / name).write_bytes(b"".join(map(pack, recs)))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).orderBy("record_id").collect()
    assert [len(r["payload"]) for r in got] == [0, 5000, 10000, 15000] and got[1]["target_uri"] == "http://x/1"
    heads = spark.read.format("warc").option("payload", "false").load(str(tmp_path)).filter("target_uri = 'http://x/3'").collect()
    assert [(r["payload_length"], r["payload"]) for r in heads] == [(15000, None)]


class _Counted:
    """A file in memory that adds up what is read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        out = self.data[at : at + n]
        self.read += len(out)
        return out


def _record(i, payload):
    fields = {"record_id": f"urn:x:{i}", "record_type": "response", "target_uri": f"http://x/{i}", "refers_to": None, "payload_digest": None, "payload_length": len(payload)}
    return warc.record(fields, payload)


@pytest.mark.parametrize("kind", ["plain", "gzip", "sl"])
def test_records_of_all_sizes(kind):
    import gzip
    import random

    rng = random.Random(3)
    pack = {"plain": lambda r: r, "gzip": gzip.compress, "sl": warc.gzip_member}[kind]
    payloads = [rng.randbytes(n) for n in (0, 1, 3_900, 4_096, 16_384, 70_000, 5, 3_000_000, 12, 1 << 20, 0)]
    data = b"".join(pack(_record(i, p)) for i, p in enumerate(payloads))
    assert [p for _, p, _ in warc.records(_Counted(data), 0, len(data), lambda head: True, True)] == payloads
    odd = lambda head: head[b"warc-target-uri"][-1:] in b"13579"
    assert [p for _, p, _ in warc.records(_Counted(data), 0, len(data), odd, True)] == payloads[1::2]
    assert [(p, n) for _, p, n in warc.records(_Counted(data), 0, len(data), odd, False)] == [(None, len(p)) for p in payloads[1::2]]
    with pytest.raises(ValueError):
        list(warc.records(_Counted(data[:-40]), 0, len(data), lambda head: True, True))


@pytest.mark.parametrize("kind", ["plain", "sl"])
def test_rejected_records_are_not_read(kind):
    import random

    pack = {"plain": lambda r: r, "sl": warc.gzip_member}[kind]
    body = random.Random(1).randbytes(8 << 20)
    file = _Counted(b"".join(pack(_record(i, body)) for i in range(4)))
    assert [h[b"warc-target-uri"] for h, *_ in warc.records(file, 0, len(file.data), lambda head: head[b"warc-target-uri"] == b"http://x/9", True)] == []
    assert file.read <= 4 * (1 << 20)


def test_unwanted_members_of_unknown_length_stay_small():
    import gzip
    import tracemalloc

    data = gzip.compress(_record(0, b"z" * (200 << 20)), 1) + gzip.compress(_record(1, b"last"))
    tracemalloc.start()
    got = [p for _, p, _ in warc.records(_Counted(data), 0, len(data), lambda head: head[b"warc-target-uri"] == b"http://x/1", True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [b"last"] and peak < 16 << 20


def test_record_ids_are_those_of_their_rows(spark, tmp_path):
    rows = [(1, "u", "a" * 200), (1, "u", "b" * 200), (None, "u", "c"), (None, "u", "d"), (2, "u", "a" * 200)]
    path = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = spark.read.format("warc").load(path).collect()
    ids = {r["record_id"] for r in got}
    assert len(ids) == len(rows)
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert len(revisits) == 1 and revisits[0]["refers_to"] in ids


# ---- chat


@given(st.text(alphabet=st.sampled_from("# </turn>\\aé\n"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"(?<!\\)(### |</turn>)", chat.escape(text))


def test_formatted_text_and_masks():
    t = chat.Template(chat.vocabulary())
    turns = [("user", "hi ### there"), ("assistant", "yes </turn> \\### x"), ("assistant", "")]
    ids, mask = t.turns(turns)
    assert t.render(ids) == "### user:\nhi \\### there</turn>\n### assistant:\nyes \\</turn> \\\\### x</turn>\n### assistant:\n</turn>\n"
    assert [x[:2] for x in t.parse(ids, mask)] == turns
    assert chat.unescape(t.text(ids[mask > 0])) == "yes </turn> \\### x"
    assert (ids >= t.open).sum() == 9 and len(mask) == len(ids)
