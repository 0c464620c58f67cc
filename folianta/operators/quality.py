"""Data-quality rules and reconciliation with a source."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianta.functions import text as tx
from folianta.operators.relational import number_gaps

# Words of placeholders and of footers.
PLACEHOLDERS = r"(?i)lorem|ipsum|placeholder|sample text|\bTODO\b|FIXME|\bdummy\b|test paragraph|xxxxx|\bNULL\b|\bundefined\b|\bNaN\b"
FOOTERS = ("copyright", "all rights reserved", "printed in", "www.", "http://", "https://")


# What each rule of the paragraph scan looks for. Characters anywhere; three of one in a row;
# patterns over the flattened text; patterns over the text as it is; all with the names they are reported by.
CHARACTERS = {"at_sign": "@", "hash_sign": "#", "percent_sign": "%"}
TRIPLED = "@#%*_=~-"
FLAT_PATTERNS = {
    "spaced_letters": (r"\b[A-Z]\s+[A-Z]\s+(?:[A-Z]\s+)*[A-Z]\b", r"\b[a-z]\s+[a-z]\s+[a-z]\s+[a-z]\s+(?:[a-z]\s+)*[a-z]\b"),
    "encoding": ("[ÃÂâ€�]",),
    "page_label": (r"^(?i:page)?\s*\d{1,4}$", r"^(?i:page)\s+\d+\s+(?:(?i:of)\s+\d+)?$", r"^\d\d-\d{4}\s"),
}
RAW_PATTERNS = {"control_characters": (r"[\x00-\x08\x0B\x0C\x0E-\x1F]",), "repeated_space": (r"[ \t]{4}",)}
#: Rules in the order of their reports.
ORDER = ("at_sign", "hash_sign", "percent_sign", "repeated_symbols", "spaced_letters", "encoding", "control_characters", "repeated_space", "footer", "page_label", "short_junk")


def _any(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests)


def rules(text: Column, flat: Column) -> dict[str, Column]:
    """Name and test of each rule for a paragraph and its flattened text; a text may break several.

    One look at a text's characters settles the plain character rules for those that have none of them.
    """
    marked = flat.rlike(f"[{TRIPLED[:-1]}]|---")
    found = {name: marked & F.contains(flat, F.lit(c)) for name, c in CHARACTERS.items()}
    found["repeated_symbols"] = marked & _any(F.contains(flat, F.lit(3 * c)) for c in TRIPLED)
    found |= {name: _any(flat.rlike(p) for p in patterns) for name, patterns in FLAT_PATTERNS.items()}
    found |= {name: _any(text.rlike(p) for p in patterns) for name, patterns in RAW_PATTERNS.items()}
    found["footer"] = _any(F.contains(F.lower(flat), F.lit(w)) for w in FOOTERS)
    found["short_junk"] = F.length(flat).between(1, 4) & ~flat.rlike(r"[\p{L}\p{Nd}]")
    return {name: found[name] for name in ORDER}


def with_reasons(df: DataFrame) -> DataFrame:
    """Rows (with ``text``) and ``reasons``: names of the broken rules, in order."""
    flat = df.withColumn("__flat", tx.once(tx.flatten_spaces(F.col("text"))))
    tests = {n: F.coalesce(t, F.lit(False)) for n, t in rules(F.col("text"), F.col("__flat")).items()}
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())
    return flat.withColumn("reasons", tx.once(found)).drop("__flat")


def severity(reason: Column) -> Column:
    """3 for damage, 2 for what shows on a page, 1 for the rest."""
    return F.when(reason.isin("encoding", "control_characters", "spaced_letters"), 3).when(reason.isin("repeated_symbols", "footer", "page_label", "short_junk"), 2).otherwise(1)


def suggested(text: Column) -> Column:
    """The text after the repairs that are safe: control characters dropped, spaces collapsed, letter-spaced words joined."""
    return tx.clean_display(tx.flatten_spaces(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")))


def library_defects(text: Column, previous: Column) -> Column:
    """Names of the library-wide defects of a paragraph."""
    tests = {
        "empty": F.trim(text) == "",
        "placeholder": text.rlike(PLACEHOLDERS),
        "leading_number": text.rlike(r"^\d{1,4}(?:\s|\.\.\.)"),
        "running_head": text.rlike(r"(?:\b\p{Lu}[\p{Lu}'’,\-]*\s+){3,}[\p{Lu}'’,\-]*\.\.\.\s*\d{1,4}\b"),
        "same_as_previous": F.coalesce(text == previous, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))


def compare_paragraphs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Source and stored paragraphs by (work_id, number): ``issue`` null, missing_opening, missing, unexpected, spacing, cut, shorter or mismatch.

    Texts are held against each other by their letters and digits. Spacing: the same but for
    white space. Cut: the stored text is the source's beginning. Shorter: by over 80 characters.
    """
    a = expected.select("work_id", "number", F.col("text").alias("source"), F.lit(True).alias("__e"))
    b = actual.select("work_id", "number", F.col("text").alias("stored"), F.lit(True).alias("__a"))
    ka, kb = tx.alnum_key(F.col("source"), False), tx.alnum_key(F.col("stored"), False)
    bare = lambda c: F.regexp_replace(c, r"[\s\x0B]+", "")
    issue = (
        F.when(F.col("__a").isNull(), F.when(F.col("number") == 1, "missing_opening").otherwise("missing"))
        .when(F.col("__e").isNull(), "unexpected")
        .when(F.col("source") == F.col("stored"), F.lit(None))
        .when(bare(F.col("source")) == bare(F.col("stored")), "spacing")
        .when(ka == kb, F.lit(None))
        .when((kb != "") & F.startswith(ka, kb), "cut")
        .when(F.length(ka) - F.length(kb) > 80, "shorter")
        .otherwise("mismatch")
    )
    return a.join(b, ["work_id", "number"], "full_outer").withColumn("issue", issue).drop("__e", "__a")


def length_shortfall(expected: DataFrame, actual: DataFrame, least: float = 0.98) -> DataFrame:
    """Works whose stored text is less than ``least`` of the source's length."""
    total = lambda df, name: df.groupBy("work_id").agg(F.sum(F.length("text")).alias(name))
    both = total(expected, "source_length").join(total(actual, "stored_length"), "work_id", "left").withColumn("stored_length", F.coalesce("stored_length", F.lit(0)))
    return both.filter(F.col("stored_length") < F.col("source_length") * least)


def compare_lines(expected: Column, actual: Column) -> Column:
    """Issue of a section's lines against its source, arrays of lines: null, missing_section, formatting_only, repeated_removed, missing_trailing, truncated, missing_lines or changed_wording."""
    key = lambda a: F.filter(F.transform(a, lambda x: tx.alnum_key(x, False)), lambda x: x != "")
    a, b = key(expected), key(actual)
    joined = lambda x: F.array_join(x, "")
    return (
        F.when(F.size(b) == 0, F.when(F.size(a) > 0, "missing_section"))
        .when(expected == actual, F.lit(None))
        .when(joined(a) == joined(b), "formatting_only")
        .when((F.size(F.array_except(a, b)) == 0) & (F.size(b) < F.size(a)) & (F.array_distinct(a) == F.array_distinct(b)), "repeated_removed")
        .when((F.size(b) < F.size(a)) & (F.slice(a, 1, F.greatest(F.size(b), F.lit(1))) == b), "missing_trailing")
        .when(F.startswith(joined(a), joined(b)), "truncated")
        .when(F.size(F.array_except(a, b)) > 0, F.when(F.size(F.array_except(b, a)) > 0, "changed_wording").otherwise("missing_lines"))
        .otherwise("changed_wording")
    )


_TOKEN = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]")
_OPS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("op", T.StringType()), T.StructField("stored", T.StringType()), T.StructField("source", T.StringType())]))


def align(stored: str | None, source: str | None, longest: int | None = None) -> list[dict[str, str]]:
    """Differences of two texts by tokens, classified.

    number: one or two numbers that only the source has; punct: no words on either side;
    spacing: the same letters with other word boundaries; stored_only; source_only; diff. With
    ``longest`` the texts of a difference are cut to so many characters, as reports do.
    """
    a, b = _TOKEN.findall(stored or ""), _TOKEN.findall(source or "")
    out = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        wa, wb = [t for t in a[i1:i2] if t[0].isalnum()], [t for t in b[j1:j2] if t[0].isalnum()]
        if op == "insert" and 0 < len(wb) <= 2 and all(w.isdigit() for w in wb):
            kind = "number"
        elif not wa and not wb:
            kind = "punct"
        elif "".join(wa) == "".join(wb):
            kind = "spacing"
        else:
            kind = {"delete": "stored_only", "insert": "source_only"}.get(op, "diff")
        out.append({"kind": kind, "op": op, "stored": " ".join(a[i1:i2])[:longest], "source": " ".join(b[j1:j2])[:longest]})
    return out


@F.pandas_udf(_OPS)
def aligned(stored: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([align(a, b) for a, b in zip(stored, source, strict=True)])


def repair(stored: str | None, source: str | None) -> str | None:
    """The source's text where it proves a repair: it has the same letters and digits in order; else None."""
    if stored is None or source is None or stored == source:
        return None
    bare = lambda s: "".join(c for c in s if c.isalnum()).lower()
    return source if bare(stored) == bare(source) and bare(stored) else None


@F.pandas_udf(T.StringType())
def proven_repair(stored: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([repair(a, b) for a, b in zip(stored, source, strict=True)], dtype=object)


def resegmentation_ok(old: DataFrame, new: DataFrame) -> DataFrame:
    """Works whose new paragraphs have the words of the old ones in order, and contiguous numbers from 1."""
    words = lambda df, name: df.groupBy("work_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda x: tx.flatten_spaces(x["text"])), " ").alias(name))
    numbers = new.groupBy("work_id").agg((F.min("number") == 1).alias("starts"), (F.max("number") == F.count("*")).alias("dense"))
    both = words(old, "a").join(words(new, "b"), "work_id").join(numbers, "work_id")
    return both.select("work_id", ((F.col("a") == F.col("b")) & F.col("starts") & F.col("dense")).alias("accepted"))


def unknown_words(texts: DataFrame, vocabulary: DataFrame, least: int = 3) -> DataFrame:
    """(language, token) of texts (language, text) seen less than ``least`` times in the vocabulary (language, token, n)."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    tokens = texts.select("language", F.explode(words).alias("token")).distinct()
    return tokens.join(vocabulary.filter(F.col("n") >= least), ["language", "token"], "left_anti")


def coverage(text: str | None, pieces: Sequence[str] | None) -> float:
    """Share of a text's words that lie in a verbatim occurrence of one of the pieces."""
    t = (text or "").split()
    flat, covered = " " + " ".join(t) + " ", [False] * len(t)
    starts, at = {}, 1
    for i, w in enumerate(t):
        starts[at] = i
        at += len(w) + 1
    for piece in pieces or ():
        needle = f" {' '.join(piece.split())} "
        i = flat.find(needle) if needle.strip() else -1
        while i >= 0:
            k = starts[i + 1]
            covered[k : k + needle.count(" ") - 1] = [True] * (needle.count(" ") - 1)
            i = flat.find(needle, i + 1)
    return sum(covered) / len(t) if t else 0.0


@F.pandas_udf(T.DoubleType())
def covered_share(text: pd.Series, pieces: pd.Series) -> pd.Series:
    return pd.Series([coverage(t, None if p is None else list(p)) for t, p in zip(text, pieces, strict=True)])


def expected_counts(counts: DataFrame, expectations: DataFrame) -> DataFrame:
    """Counts (name, n) against (name, low, high): ``passed``; a name without a count fails."""
    return expectations.join(counts, "name", "left").withColumn("passed", F.coalesce(F.col("n").between(F.col("low"), F.col("high")), F.lit(False)))


def numbering_faults(paragraphs: DataFrame) -> DataFrame:
    """Per work: gaps in the numbering, and the first number."""
    gaps = number_gaps(paragraphs.select("work_id", "number"), ["work_id"], "number").groupBy("work_id").agg(F.count("*").alias("gaps"))
    return paragraphs.groupBy("work_id").agg(F.min("number").alias("first_number")).join(gaps, "work_id", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
