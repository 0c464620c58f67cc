"""Personal data: base rules, and identifiers found by bootstrapped contextual extraction.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers in every
whole text. With tokens in the shape of a secret (a long hexadecimal key, a published key format)
they are the seeds of a bootstrap over the corpus. The one, two or three words before a seed and
the one or two after it are lexical patterns (``contact number:``), and any other identifier-shaped
token beside the same words is a candidate. Spark scores the bipartite graph of patterns and
instances in turns: a pattern is as reliable as the share of its distinct instances that are
believed (and it needs several of them, nearly all seeds among them of one kind, which a mere common
word hasn't), an instance is believed if reliable patterns hold it. Patterns that end above a
threshold give the unseen identifiers, added as spans of kind ``id``; secret-shaped seeds are added
too where such a pattern holds them, and left alone elsewhere, as a checksum has their shape.

Instances are counted once each, not by occurrence, so that copies of a document bear no
witness. Counting and scoring are joins and aggregates; nothing but a change count reaches the
driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.llm.common import cut, joined_by_hot_key, small_batches, slices, text_array

#: Kinds in the order in which spans are listed; the base rules', then the bootstrap's.
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

# Fixed patterns of the base rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Rounds of scoring patterns and instances.
ROUNDS = 3
#: Distinct believed instances that a pattern needs, and the least reliability of a pattern in use.
SUPPORT, RELIABLE = 5, 0.5
#: Belief from which an instance counts for its patterns.
BELIEVED = 0.5
#: Share of a pattern's seeds that are of one kind.
PURE = 0.8
#: Words of a pattern before a place and after it: all numbers up to these.
BEFORE, AFTER = 3, 2
#: Fewest characters of an identifier-shaped token; there is no most.
SHORTEST = 4

# Published shapes of secrets.
_SECRET = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
# A token with a digit or an underscore inside; quotes, brackets and closing punctuation are not part of it.
# Groups of digits and capitals that follow with single spaces belong to it (an IBAN, a number in groups).
_CORE = r"[^\s\"'(),;:<>\[\]{}|=]"
_TOKEN = re.compile(rf"{_CORE}*[0-9_]{_CORE}*(?:\x20[0-9A-Z]*[0-9][0-9A-Z]*(?!{_CORE}))*")
_TRAIL = ".!?*%&$#"
_WORD = re.compile(r"[^\W\d_]+(?:[^\S\n]?[:=#])?")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses: around each at sign the longest local part to the left, a dotted domain to the right.

    Equal to a leftmost scan with the rule's pattern, as a local part can't cross an at sign.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = None
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            free = end
        at = text.find("@", end or at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each base kind, in code points, end exclusive; matches that fail a test are dropped without a retry."""
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a place: its last words before and first words after, lower case, with a colon,
    equals or hash sign that follows a word; ``<`` and ``>`` tell the sides apart. A label may stand on the line before.
    """
    reach = 64
    while True:
        before = _WORD.findall(text[max(0, start - reach) : start].lower())
        if len(before) > BEFORE or reach >= start:  # the first word may be cut
            break
        reach *= 4
    before = [w.replace(" ", "") for w in before[-BEFORE:]]
    after = []
    for m in _WORD.finditer(text, end):
        after.append(m[0].lower().replace(" ", ""))
        if len(after) == AFTER:
            break
    return ["< " + " ".join(before[-k:]) for k in range(1, len(before) + 1)] + ["> " + " ".join(after[:k]) for k in range(1, len(after) + 1)]


def candidates(text: str, spans: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Spans of identifier-shaped tokens that no base span touches."""
    taken = sorted(s for kind in spans.values() for s in kind)
    i = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in _TRAIL:
            end -= 1
        while taken[i : i + 1] and taken[i][1] <= start:
            i += 1
        if taken[i : i + 1] and taken[i][0] < end:
            continue
        if SHORTEST <= end - start:
            yield start, end


def _identity(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "little", signed=True)


#: Numbers of the kinds of seeds; 0 is no seed.
_SEEDS = (*KINDS, "secret")


def _mentions(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    marks = [(a, b, i + 1) for i, k in enumerate(KINDS) for a, b in spans[k]]
    if _DIGIT.search(text) or "_" in text:
        marks += [(a, b, len(_SEEDS) if _SECRET.fullmatch(text, a, b) else 0) for a, b in candidates(text, spans)]
    return [{"patterns": p, "instance": _identity(text[a:b]), "kind": k, "start": a, "stop": b} for a, b, k in marks if (p := contexts(text, a, b))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mention = pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    for batch in batches:
        for part in slices(batch, "text"):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base, seen = [], []
            for text in text_array(part.column("text")).to_pylist():
                spans = base_spans(text)
                for k in KINDS:
                    counts[k].append(len(spans[k]))
                base.append(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]))
                seen.append(_mentions(text, spans))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(seen, pa.list_(mention))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "mentions"],
            )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_email to n_phone, base (base spans as text) and mentions (seeds and candidates with their patterns)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mentions = "array<struct<patterns:array<string>,instance:long,kind:int,start:int,stop:int>>"
    return rows.mapInArrow(_scan, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, mentions {mentions}")


def reliable_patterns(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, reliability) of patterns in use, from mentions (pattern, instance, kind; kind 0 is no seed).

    Instances that are seeds anywhere are believed throughout. In each round a pattern's
    reliability is the share of believed ones among its distinct instances, 0 below SUPPORT
    of them or where less than PURE of its seeds are of one kind; then an instance's belief is one
    minus the product of its patterns' unreliabilities.
    """
    edges = cut(mentions.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    seeds = edges.filter("kind > 0").select("instance").distinct().withColumn("belief", F.lit(1.0))
    beliefs = seeds
    of_kind = [F.count_if(F.col("kind") == i + 1) for i in range(len(_SEEDS))]
    for i in range(rounds):
        known = edges.join(beliefs, "instance", "left").withColumn("held", (F.coalesce("belief", F.lit(0.0)) >= BELIEVED).cast("int"))
        scored = known.groupBy("pattern").agg(F.sum("held").alias("good"), F.count("*").alias("all"), F.count_if(F.col("kind") > 0).alias("seeds"), F.greatest(*of_kind).alias("top"))
        useful = (F.col("good") >= SUPPORT) & (F.col("top") >= PURE * F.col("seeds"))
        patterns = cut(scored.filter(useful).select("pattern", (F.col("good") / F.col("all")).alias("reliability")))
        if i < rounds - 1:
            lent = edges.join(patterns, "pattern").groupBy("instance").agg(F.sum(F.log1p(-F.least("reliability", F.lit(0.999)))).alias("doubt"))
            beliefs = cut(lent.select("instance", (1 - F.exp("doubt")).alias("belief")).join(seeds.select("instance"), "instance", "left_anti").union(seeds))
    return patterns.filter(F.col("reliability") >= RELIABLE)


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_id.

    ``spans`` lists all spans as kind:start:end, by kind in the order of KINDS and then ``id``,
    then by start; base_sha256 is the SHA-256 of the base part. Null text counts as empty;
    rows that repeat an id keep their own results; other columns are ignored.
    """
    rows = cut(scanned(docs).withColumn("row", F.monotonically_increasing_id()))
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", F.explode("m.patterns").alias("pattern"), "m.instance", "m.kind", "m.start", "m.stop")
    patterns = reliable_patterns(mentions.select("pattern", "instance", "kind"), rounds)
    unnamed = mentions.filter((F.col("kind") == 0) | (F.col("kind") > len(KINDS)))
    used = unnamed.groupBy("pattern").agg(F.count("*").alias("n")).join(patterns, "pattern", "left_semi")
    hits = joined_by_hot_key(unnamed, used, "pattern", "n", "inner", "row", "start").select("row", "start", "stop").distinct()
    span = F.struct("start", "stop")
    added = hits.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("more"))
    listed = F.array_join(F.transform("more", lambda x: F.format_string(f"{FOUND}:%d:%d", x["start"], x["stop"])), ",")
    out = rows.join(added, "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), listed)
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_id"))
