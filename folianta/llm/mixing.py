"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed in cells of (source, lang, topic). Raking scales the cells' weights to the
target share of each source, each language and each topic in turn, sweep after sweep, until
all three marginals hold at once. A document's rate is its cell's weight per token, scaled so
that ``KEEP`` of all tokens are expected to be drawn. It is drawn with the rate as probability;
a rate above one (a small category lifted far) means a sure draw whose weight is the rate, the
epochs for which training should see it. Expected weighted tokens so follow the targets
exactly. A hash of the id decides, so any run draws the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianta.llm.common import cut

#: Sweeps over the three marginals. Each shrinks the error by a constant factor.
SWEEPS = 8
#: Default targets: a category's share of tokens to this power, normalised. Below 1 it lifts small ones.
TEMPER = 0.7
#: Share of all tokens that the sample is meant to have.
KEEP = 0.5
#: Decimal places to which a rate is fixed before it is compared.
PLACES = 9
#: Cell tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_CELLS = 20_000

DIMENSIONS = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    """Words between the six ASCII spaces."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic of the whole text by its form; the first that fits.

    empty (no token), data (over a fifth digits), shout (over a quarter ASCII capitals), table (a bar for every 40 characters), brief (under 200 characters), prose.
    """
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "empty")
        .when(F.regexp_count(text, F.lit("[0-9]")) * 5 > n, "data")
        .when(F.regexp_count(text, F.lit("[A-Z]")) * 4 > n, "shout")
        .when(bars * 40 > n, "table")
        .when(n < 200, "brief")
        .otherwise("prose")
    )


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic and tokens of each row; nulls count as the category ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (topic_of(text) if topic is None else F.coalesce(topic, F.lit(""))).alias("topic"),
        tokens_of(text).alias("tokens"),
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, temper: float = TEMPER) -> DataFrame:
    """Cells with ``weight`` (shares that sum to one) raked to the targets.

    ``targets[dimension]`` has (dimension, share); categories missing there, and dimensions
    missing altogether, aim at their tempered share of tokens. Cells without tokens get weight 0.
    """
    targets = targets or {}
    out = cells.filter("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        sums = cells.filter("tokens > 0").groupBy(d).agg(F.sum("tokens").cast("double").alias("t"))
        sums = sums.withColumn("given", F.pow(F.col("t") / sums.agg(F.sum("t")).scalar(), F.lit(temper)))
        if d in targets:
            sums = sums.join(targets[d].select(F.col(d), F.col("share").cast("double").alias("asked")), d, "left").withColumn("given", F.coalesce("asked", "given")).drop("asked")
        sums = sums.withColumn(f"to_{d}", F.col("given") / sums.agg(F.sum("given")).scalar()).select(d, f"to_{d}")
        out = out.join(sums, d)
    out = cut(out.select(*DIMENSIONS, "tokens", "weight", *[f"to_{d}" for d in DIMENSIONS]))
    for i in range(sweeps):
        for d in DIMENSIONS:
            held = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"to_{d}") / held).otherwise(0.0))
        if i % 4 == 3:
            out = cut(out)
    return out


def _scaled(rows: DataFrame, targets: dict[str, DataFrame] | None, sweeps: int, keep: float) -> DataFrame:
    """Cells with their rate ``r``, rounded to PLACES; marked for broadcast if they are few, which is counted."""
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets, sweeps)
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    scaled = cut(raked.select(*DIMENSIONS, F.round(F.col("weight") / F.col("tokens") * total * keep, PLACES).alias("r")))
    return F.broadcast(scaled) if scaled.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else scaled


def cells_of(docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """Rates of the cells of ``docs``."""
    return _scaled(described(docs), targets, sweeps, keep)


def rated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """``described(docs)`` with ``rate``, rounded to PLACES.

    Documents without tokens carry no weight and have rate 1: keeping them changes no marginal.
    """
    rows = cut(described(docs, topic))
    side = _scaled(rows, targets, sweeps, keep)
    return rows.join(side, list(DIMENSIONS), "left").withColumn("rate", F.coalesce("r", F.lit(1.0))).drop("r")


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id: 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies_of(rate: Column, doc_id: Column) -> Column:
    """How often a document enters the sample: the whole part of its rate, and once more by its draw for the rest."""
    return (F.floor(rate) + (draw(doc_id) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, tokens, probability, weight, sampled, copies.

    A sample with ``copies`` of each document has the expected marginals of the targets; one with each
    ``sampled`` document once has them under ``weight``. Nulls are categories of their own, repeated rows count
    with each row and are drawn alike, other columns are ignored, and an empty table gives no rows.
    """
    rate, doc_id = F.col("rate"), F.col("doc_id")
    return rated(docs, targets, sweeps, keep).select(
        "doc_id", *DIMENSIONS, "tokens",
        F.round(F.least(rate, F.lit(1.0)), 6).alias("probability"), F.round(F.greatest(rate, F.lit(1.0)), 6).alias("weight"),
        (draw(doc_id) < rate).alias("sampled"), copies_of(rate, doc_id).alias("copies"),
    )


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """Rows of ``docs``, with its columns, drawn so that their expected tokens meet every marginal.

    A document of a category that is to grow beyond what there is of it comes several times (``copies``), as
    sources do that are read for several epochs. Rows are rated by their own source, language and form, so rows that
    share an id, or have none, are told apart; null texts and those without a token come once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scaled = cells_of(docs, targets, sweeps, keep)
    # the cell of a row is computed beside the row, so no text is shuffled to meet its rate
    named = docs.withColumns({
        "__folianta_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "__folianta_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "__folianta_topic": topic_of(text),
    })
    side = scaled.select(*[F.col(d).alias(f"__folianta_{d}") for d in DIMENSIONS], F.col("r").alias("__folianta_rate"))
    rows = named.join(side, [f"__folianta_{d}" for d in DIMENSIONS], "left")
    copies = copies_of(F.coalesce("__folianta_rate", F.lit(1.0)), F.col("doc_id").cast("long"))
    many = rows.withColumn("__folianta_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
    return many.select(*[F.col(c) for c in docs.columns])
