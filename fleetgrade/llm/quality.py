"""Quality rules: a threshold table compiled into one Spark projection (operator 7, native).

Every ratio is a column expression over the whole text. ``THRESHOLDS`` lists
(rule, metric, lowest, highest) and ``compile_rules`` turns it into one projection; a
document is kept when no rule fires. No user function, no shuffle: a document is judged
where it is read, so hot sources or copies cost no more than other rows.

Repeated 3-word windows are found by sorting a document's own window hashes (64 bits of
three chained word hashes) with their positions, which is n log n in its words; a chance
collision inside one text has a probability below n^2 / 2^65.

Edge cases: a null text counts as empty (0 words, rejected); extra columns are ignored
unless asked for with ``keep``; repeated rows are judged row by row; an empty table gives
an empty result; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.llm.common import SPACE, let, text_of, words

# The symbol characters of the contract.
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = ("the of and to in is that with for on "
              "der die und das von zu mit den ist ein "
              "de la le les des et un une que pour "
              "el los las en por con del una se su").split()
# rule, metric, lowest and highest accepted value (None: open).
THRESHOLDS = (
    ("mean_word_length", "mean_word_length", 2.0, 14.0),
    ("symbol_word_ratio", "symbol_word_ratio", None, 0.3),
    ("bang_word_ratio", "bang_word_ratio", None, 0.6),
    ("stop_word_ratio", "stop_word_ratio", 0.01, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.5),
)
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 50, 50


def _occurrences(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""
    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p"))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), window))
    covered = let(windows, lambda s: F.size(F.array_distinct(F.flatten(
        F.transform(repeated(s), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))))
    return F.when(F.size(ws) >= 3, covered).otherwise(0).cast("long")


def line_counts(text: Column) -> Column:
    """(lines with a word, those equal to an earlier one)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    return let(lines, lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("dup")))


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts of every document, as one projection."""
    text = text_of()
    by_words = let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeat_words(ws).alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop")))
    # One struct per document: its fields are read below without computing it again.
    m = F.struct(by_words.alias("w"), line_counts(text).alias("l"),
                 F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                 _occurrences(text, SYMBOLS).alias("n_symbols"), _occurrences(text, "!").alias("n_bangs"))
    return docs.select(*keep, F.inline(F.array(m)))


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """Names of the rules that fire, from the threshold table."""
    n = F.greatest(F.col("w.n_words"), F.lit(1))
    metrics = {
        "mean_word_length": F.col("word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "bang_word_ratio": F.col("n_bangs") / n,
        "stop_word_ratio": F.col("w.n_stop") / n,
        "dup_line_ratio": F.col("l.dup") / F.greatest(F.col("l.n"), F.lit(1)),
    }
    fired = []
    for rule, metric, low, high in thresholds:
        out = F.lit(False)
        if low is not None:
            out = out | (metrics[metric] < F.lit(low))
        if high is not None:
            out = out | (metrics[metric] > F.lit(high))
        fired.append(F.when(out, F.lit(rule)))
    return F.filter(F.array(*fired), lambda r: r.isNotNull())


def judge(docs: DataFrame, thresholds=THRESHOLDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base verdict, fired rules and ``kept`` for every row of ``docs``."""
    n, rep = F.col("w.n_words"), F.col("w.n_repeat_words")
    base = (n < BASE_MIN_WORDS) | (100 * rep > BASE_REPEAT_PERCENT * n)
    return (measures(docs, keep).withColumn("fired", compile_rules(thresholds))
            .select(*keep, n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"),
                    rep.alias("n_repeat_words"), base.alias("base_failed"),
                    (~base & (F.size("fired") == 0)).alias("kept"), F.array_join("fired", ",").alias("fired")))


def keep_documents(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return judge(rows, thresholds, ("_row",)).where("kept").select("_row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return judge(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bounds = {r: (lo, hi) for r, _, lo, hi in THRESHOLDS}
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text,
             list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as ls
      from d),
tok as (select doc_id, unnest(range(1, len(ws) - 1)) as p, ws from w where len(ws) >= 3),
tri as (select doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as g from tok),
rep as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as n from tri) where n >= 2),
cov as (select doc_id, count(distinct q) as n from
        (select doc_id, p as q from rep union all select doc_id, p + 1 from rep union all select doc_id, p + 2 from rep)
        group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
             cast(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             length(text) - length(replace(text, '!', '')) as n_bangs,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines,
             cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) in ({stops}))) as n_stop
      from w left join cov on w.doc_id = cov.doc_id),
r as (select *, n_words < {BASE_MIN_WORDS} or 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words as base_failed,
             concat_ws(',',
               case when word_chars / greatest(n_words, 1) < {bounds['mean_word_length'][0]}
                      or word_chars / greatest(n_words, 1) > {bounds['mean_word_length'][1]} then 'mean_word_length' end,
               case when n_symbols / greatest(n_words, 1) > {bounds['symbol_word_ratio'][1]} then 'symbol_word_ratio' end,
               case when n_bangs / greatest(n_words, 1) > {bounds['bang_word_ratio'][1]} then 'bang_word_ratio' end,
               case when n_stop / greatest(n_words, 1) < {bounds['stop_word_ratio'][0]} then 'stop_word_ratio' end,
               case when n_dup_lines / greatest(n_lines, 1) > {bounds['dup_line_ratio'][1]} then 'dup_line_ratio' end) as fired
      from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and fired = '' as kept, fired
from r"""


ORACLE = _oracle()
