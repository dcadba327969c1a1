"""Exact "text contains any pattern" joins without pairing every row with every pattern.

A theta join on ``contains`` pairs each text with each pattern of its group; in
a workspace with many jobs and many principals that is every pair in the
group. ``containing_texts`` indexes each pattern by its rarest gram instead: of the pattern's
pieces of ``GRAM`` characters, the one that the fewest distinct texts of the group hold. A
text's own pieces fetch the patterns listed under them by an equi-join, and only those
candidates are verified. A pattern with a piece that no text holds is never fetched at all.
Texts are made distinct first, so a creator of a million jobs is looked at once. Of a text's
pieces only those go on that some pattern of its group may hold: each group's patterns are
summed up as the set of hash buckets (``BUCKETS`` at most) of their pieces, and a text's other
pieces, nearly all of them, are dropped where they are cut. A bucket that two pieces share only
lets one too many through, which the equi-join drops.

``contains_matches`` (for the static rule names) cuts texts into substrings of the
patterns' lengths and equi-joins those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.fold import shuffled

GRAM = 3
BUCKETS = 1024


def _grams(text: str, size) -> Column:
    """Distinct pieces of ``size`` characters of a text column."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(F.col(text), i, size))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def asked_pieces(texts: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """Distinct pieces ``_g`` of each text in buckets that the group's pattern pieces (``of``: keys, ``_size``, ``_g``) fall in."""
    # Patterns shorter than a gram are their own piece, so texts are cut to the sizes their group needs.
    asked = of.groupBy(*keys, "_size").agg(F.collect_set(_bucket(F.col("_g"))).alias("_asked"))
    held = F.filter(_grams("_t", F.col("_size")), lambda g: F.array_contains(F.col("_asked"), _bucket(g)))
    return texts.where(F.length("_t") > 0).join(shuffled(asked), on=keys).select(*texts.columns, F.explode(held).alias("_g"))


def containing_texts(texts: DataFrame, keys: list[str], patterns: DataFrame) -> DataFrame:
    """Rows of ``texts`` (keys, ``_t``, distinct; further columns are kept) that contain some ``_p`` of ``patterns`` (keys, ``_p``)."""
    pats = patterns.where(F.length("_p") > 0).distinct().withColumn("_size", F.least(F.length("_p"), F.lit(GRAM)))
    of = pats.select(*keys, "_p", "_size", F.size(_grams("_p", F.col("_size"))).alias("_all"), F.explode(_grams("_p", F.col("_size"))).alias("_g"))
    pieces = asked_pieces(texts, keys, of).repartition(*keys, "_g")       # a group's pieces are spread
    spread = pieces.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (of.join(shuffled(spread), on=[*keys, "_g"]).groupBy(*keys, "_p", "_all")
              .agg(F.min(F.struct("_df", "_g")).alias("_r"), F.count(F.lit(1)).alias("_held"))
              .where(F.col("_held") == F.col("_all")).select(*keys, "_p", F.col("_r._g").alias("_g")))
    return (pieces.join(shuffled(rarest), on=[*keys, "_g"]).where(F.col("_t").contains(F.col("_p"))).select(*texts.columns).distinct())


def count_containing(left: DataFrame, keys: list[str], text_col: str, right: DataFrame, pattern_col: str,
                     name: str, lower: bool = True) -> DataFrame:
    """Per group the number of ``left`` rows whose text contains some pattern of the group's ``right`` rows.

    Rows are counted per distinct text before anything is compared; the count goes along.
    Empty patterns are ignored (quirk Q9).
    """
    norm = F.lower if lower else (lambda c: c)
    texts = left.where(F.col(text_col).isNotNull()).groupBy(*keys, norm(F.col(text_col)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    pats = right.select(*keys, norm(F.col(pattern_col)).alias("_p"))
    return containing_texts(texts, keys, pats).groupBy(*keys).agg(F.sum("_n").cast("bigint").alias(name))


def contains_any(left: DataFrame, keys: list[str], id_cols: list[str], text_col: str,
                 right: DataFrame, pattern_col: str, lower: bool = True) -> DataFrame:
    """Rows of ``left`` whose ``text_col`` contains some ``pattern_col`` of ``right``
    with equal ``keys`` (a left semi join). Empty patterns are ignored (quirk Q9).
    """
    norm = F.lower if lower else (lambda c: c)
    texts = left.select(*keys, norm(F.col(text_col)).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    hits = containing_texts(texts, keys, right.select(*keys, norm(F.col(pattern_col)).alias("_p")))
    return left.withColumn("_t", norm(F.col(text_col))).join(hits, on=[*keys, "_t"], how="left_semi").select(*left.columns)


def contains_matches(left: DataFrame, keys: list[str], id_cols: list[str], text_col: str,
                     right: DataFrame, pattern_col: str, carry: list[str], lower: bool = True) -> DataFrame:
    """Every (left row, right row) pair whose pattern occurs in the text, as
    ``keys + id_cols + carry`` (an inner join on containment, same cutting as
    ``contains_any``)."""
    norm = F.lower if lower else (lambda c: c)
    pats = (right.select(*keys, *carry, norm(F.col(pattern_col)).alias("_p"))
            .where(F.col("_p").isNotNull() & (F.length("_p") > 0)))
    ident = [c for c in id_cols if c not in keys]
    texts = left.select(*keys, *ident, norm(F.col(text_col)).alias("_t")).where(F.col("_t").isNotNull())
    if keys:
        lens = pats.select(*keys, F.length("_p").alias("_len")).distinct()
        cand = texts.join(lens, on=keys, how="inner").where(F.length("_t") >= F.col("_len"))
    else:
        # No group key: cut substrings of every length (bounded by the text
        # length squared) instead of pairing texts with pattern lengths.
        cand = texts.select(*ident, "_t", F.explode(F.sequence(F.lit(1), F.length("_t"))).alias("_len"))
    subs = cand.select(
        *keys, *ident,
        F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("_len") + 1),
                                               lambda i: F.substring(F.col("_t"), i, F.col("_len"))))).alias("_s"))
    joined = subs.join(pats, on=[*[subs[k] == pats[k] for k in keys], subs["_s"] == pats["_p"]], how="inner")
    return joined.select(*[subs[k] for k in keys], *ident, *carry).distinct()

