"""PII by bootstrapped contextual extraction (operator 2, native).

Base: four regular expressions find emails, IP addresses, card numbers and phone numbers
with their places (code points). They are the seeds. Around every seed, and around every
other token that holds a digit or an at sign and every run of digits with the separators of
phone and card numbers between them (the candidates), the neighbouring words, whole whatever
their length and distance, give lexical patterns: the word before, the word after, and both.
Patterns and instances (distinct values) form a graph that is scored in turns:

* a pattern's confidence for a kind is the sum of its instances' weights over the number
  of its instances (plus one); it must be met by ``MIN_SUPPORT`` known instances. Known ones
  weigh 1, candidates what the last turn made likely: their score, or the confidence of their
  best pattern. So values not seen before are not full misses, yet patterns of confidence below
  ``MIN_START`` have no say;
* a candidate's score is one minus the product of the doubts of its patterns that reach
  ``MIN_CONFIDENCE``.

Turns go on until they accept the same values as an earlier turn did. Then a candidate whose
score reaches ``ACCEPT`` becomes a span of that kind wherever one of the accepted patterns stands around it. Base spans always stay. A run and
a token in it may both become spans; masking replaces them as one.

All of it is DataFrame functions. Texts are read once; spans, contexts and no texts go to
the graph. Edges are made distinct before they are joined, so copies and hot contexts
cost one row per task; counts per pattern and per instance are aggregated before they move.

Places come from splitting the text at the matches: the lengths of the pieces between
matches and of the matches add up to every start. Patterns are written with possessive
repetition, so long runs of letters or digits take linear time and no deep recursion.

Edge cases: null texts count as empty (no spans, digest of the empty text); rows without
doc_id are served like others; repeated rows give repeated results; extra columns are
ignored by ``find`` and kept by ``mask``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.llm.common import let, text_of
from fleetgrade.session import cut_lineage

# Kinds in the order of the contract, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
TOKEN = r"(?<!\S)\S*?[0-9@]\S*+"
RUN = r"(?<![A-Za-z0-9@+._/-])\(?[0-9]++(?:[\x20().-]++[0-9]++(?![A-Za-z@_/]))++"
WINDOW = 48
MIN_SUPPORT, MIN_START, MIN_CONFIDENCE, ACCEPT = 3, 1 / 3, 0.7, 0.8
BROADCAST_SPANS = 200_000   # extra spans (three numbers each, and a key) that may be broadcast; more are joined by shuffle
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs (start, kind, stop, value), in order."""
    def places(hits: Column) -> Column:
        def step(acc, x):
            at = acc["at"] + F.length(x["gap"])
            end = at + F.length(x["hit"])
            one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"), x["hit"].alias("value")))
            return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

        pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits,
                            lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(pieces, zero, step, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), 0), places)).otherwise(
        F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    """Check sum of up to 19 digits, as text."""
    right = F.reverse(digits)
    double = F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def add(acc, i):
        d = F.substring(right, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.get(double, d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base matches of all kinds, sorted by start, then kind."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    good = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda v: let(digits(v), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)),
        "phone": lambda v: F.length(digits(v)).between(9, 15),
    }
    keeps = lambda k: lambda s: good[k](s["value"])
    found = [F.filter(located(text, PATTERNS[k], i), keeps(k)) for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


def candidates(text: Column, base: Column) -> Column:
    """Tokens with a digit or at sign and spaced numbers outside the base spans, without outer punctuation."""
    def trim(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["value"], r"^([\"'(<\[]*+)", 1))
        tail = F.length(F.regexp_extract(s["value"], r"([\"')>\].,;:!?]*)$", 1))
        n = F.greatest(F.lit(0), F.length(s["value"]) - head - tail)
        return F.struct((s["start"] + head).alias("start"), F.lit(-1).alias("kind"), (s["start"] + head + n).alias("stop"),
                        F.substring(s["value"], head + 1, n).alias("value"))

    own = F.transform(located(text, TOKEN, -1), trim)
    own = F.filter(own, lambda s: (s["value"].rlike("@") | (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 3))
                   & (F.length(s["value"]) >= 5))
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    # As many digits as phones and cards have; an unclosed bracket is outer punctuation, runs without a space are tokens.
    runs = F.filter(F.transform(located(text, RUN, -1), lambda s: F.when(s["value"].rlike(r"^\([^)]*$"), trim(s)).otherwise(s)),
                    lambda s: s["value"].contains(" ") & digits(s).between(9, 19))
    own = F.concat(own, runs)
    return F.filter(own, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))


def _with_contexts(text: Column, spans: Column) -> Column:
    """Spans with their whole neighbouring words. ``WINDOW`` code points are looked at first; where
    they end inside a word or hold blanks alone, the rest of the text is."""
    def around(s: Column) -> Column:
        at = F.greatest(F.lit(0), s["start"] - WINDOW)
        mask = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
        before, after = F.substring(text, at + 1, s["start"] - at), F.substring(text, s["stop"] + 1, F.lit(WINDOW))
        cut_before = (at > 0) & ~before.rlike(r"\s\S+\s*$")
        cut_after = (F.length(after) == WINDOW) & after.rlike(r"^[.,;:!?)\"']*\s*\S*$")
        left = F.when(cut_before, F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), s["start"])), r"^\s*(\S+)", 1))
                      ).otherwise(F.regexp_extract(before, r"(\S+)\s*$", 1))
        rest = F.when(cut_after, F.substring(text, s["stop"] + 1, F.length(text))).otherwise(after)
        right = F.regexp_extract(rest, r"^[.,;:!?)\"']*\s*(\S+)", 1)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"),
                        mask(left).alias("l"), mask(right).alias("r"))

    return F.transform(spans, around)


def found_in(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, near`` of every row: base spans, and all spans with their contexts."""
    text = text_of()
    rows = let(base_spans(text), lambda b: F.struct(
        b.alias("base"), _with_contexts(text, F.concat(b, candidates(text, b))).alias("near")))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.inline(F.array(rows)))


def bootstrap(near: DataFrame) -> DataFrame:
    """``key, start, kind, stop`` of the accepted candidates.

    ``near``: key, start, kind (-1: candidate), stop, value, l, r.
    """
    shapes = F.array(F.when(F.col("l") != "", F.concat(F.lit("L:"), "l")), F.when(F.col("r") != "", F.concat(F.lit("R:"), "r")),
                     F.when((F.col("l") != "") & (F.col("r") != ""), F.concat(F.lit("B:"), "l", F.lit(" "), "r")))
    met = near.withColumn("pattern", F.explode(shapes)).where("pattern is not null").withColumn("value", F.lower("value"))
    edges = cut_lineage(met.select("pattern", "value", "kind").distinct(), "pii-edges")
    seeds = edges.where("kind >= 0").select("value", "kind").distinct().withColumns({"score": F.lit(1.0), "weight": F.lit(1.0)})
    size = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    links = edges.select("pattern", "value").distinct()
    loose = edges.where("kind = -1").select("pattern", "value").distinct()
    known, seen = seeds, set()
    while True:
        pats = (links.join(known, "value").groupBy("pattern", "kind")
                .agg(F.sum("weight").alias("s"), F.sum((F.col("score") >= ACCEPT).cast("int")).alias("support"))
                .where(F.col("support") >= MIN_SUPPORT).join(size, "pattern")
                .select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("conf")).where(F.col("conf") >= MIN_START))
        pats = cut_lineage(pats, "pii-patterns")
        doubt = F.when(F.col("conf") >= MIN_CONFIDENCE, F.log1p(-F.col("conf"))).otherwise(0.0)
        new = (loose.join(pats, "pattern").groupBy("value", "kind")
               .agg((1 - F.exp(F.sum(doubt))).alias("score"), F.max("conf").alias("top"))
               .select("value", "kind", "score", F.greatest("score", "top").alias("weight"))
               .join(seeds.select("value", "kind"), ["value", "kind"], "left_anti"))
        known = cut_lineage(seeds.unionByName(new), "pii-known")
        # Turns end when they accept the same values as an earlier one did.
        mark = tuple(known.where(F.col("score") >= ACCEPT).agg(
            F.count("*"), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)"))).first())
        if mark in seen:
            break
        seen.add(mark)
    pats = pats.where(F.col("conf") >= MIN_CONFIDENCE)
    best = (known.where(F.col("score") >= ACCEPT).groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
            .select("value", (-F.col("b.col2")).alias("as")))
    return (met.where("kind = -1").select("key", "start", "stop", "value", "pattern").join(best, "value")
            .join(pats.select("pattern", F.col("kind").alias("as")), ["pattern", "as"], "left_semi")
            .select("key", "start", F.col("as").alias("kind"), "stop").distinct())


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def discovered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with base spans, accepted extra spans per row key), both written once."""
    found = cut_lineage(found_in(docs), "pii-found")
    near = found.select("key", F.inline("near"))
    extra = cut_lineage(bootstrap(near).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("extra")), "pii-extra")
    return found, extra


def _merge(rows: DataFrame, extra: DataFrame) -> DataFrame:
    # One key may hold many spans, so the spans are counted and not the keys.
    if (extra.agg(F.sum(F.size("extra"))).first()[0] or 0) <= BROADCAST_SPANS:
        extra = F.broadcast(extra)
    return rows.join(extra, "key", "left")


def _all(base: Column) -> Column:
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.sort_array(F.concat(plain, F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for every row."""
    rows = _merge(*discovered(docs))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(_all(F.col("base"))).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in angle brackets, ``n_chars`` brought up to date."""
    _, extra = discovered(docs)
    text = text_of()
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc, s):
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = let(_all(base_spans(text)), lambda spans: F.when(F.size(spans) > 0, F.aggregate(
        spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))).otherwise(F.col("text")))
    rows = docs.select(F.struct("*").alias("_row"), "text", F.xxhash64("doc_id", "text").alias("key"))
    out = _merge(rows, extra).select(F.col("_row").withField("text", masked).alias("_row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("_row").withField("n_chars", F.length("_row.text").cast(dict(docs.dtypes)["n_chars"])).alias("_row"))
    return out.select("_row.*")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return find(table(spark, sf_dir, "documents"))
