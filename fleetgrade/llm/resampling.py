"""Target-distribution importance resampling over hashed n-grams (operator 12).

Texts are handled in Arrow record batches: ``ascii_lower``, ``split_pattern_regex`` and
``list_flatten`` give the words of all texts of a batch in one array, ``dictionary_encode``
their numbers. Shifted numbers form word pairs, whose distinct values are dictionary encoded
as well; only distinct words and pairs get a CRC. Gains of buckets are taken by these
dictionaries' indices and summed per document by segments.

Steps: (1) one pass over each side counts features per bucket; a task sends one row per
bucket. (2) The ``buckets`` counts of both sides make the gains, a table of fixed size that
goes out with the second pass. (3) The second pass gives every document its weight; a keyed
Gumbel draw by a hash of its id makes the score. (4) A histogram of the integer scores (logs
of 64-bit ratios and of a 32-bit hash, times 1000: under 200,000 values) gives the score
where the draw ends; documents from there on are numbered by range partitions and offsets,
so no task ranks more than its range.

Every text is read whole; long batches are handled in slices of about ``SLICE_CHARS`` bytes
of text, one document at least, so memory follows the longest text.

Edge cases: null and empty texts have no words, weight 0 and no rank; a null doc_id is drawn
with the empty id and ranks after all others on ties; repeated rows are documents of their
own that share a score, rank next to each other and take one number each; an empty target
table leaves all target counts 0; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.numbering import numbered
from fleetgrade.session import cut_lineage

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_CHARS = 16_000_000


def slices(batch, column: str = "text"):
    """Parts of a record batch with about ``SLICE_CHARS`` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE_CHARS, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def bucketed(texts, buckets: int = BUCKETS):
    """``words`` per text, and ``owner, bucket`` of every feature of an Arrow string array."""
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=SEPARATORS)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    word = pc.not_equal(flat, "")
    flat, owner = flat.filter(word), owner.filter(word).to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    one = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    # Pairs of neighbours of one text, as one number each.
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    pairs = pa.array(ids[inside] * len(names) + ids[inside + 1]).dictionary_encode()
    distinct = pairs.dictionary.to_numpy()
    starts = [zlib.crc32(b" ", int(c)) for c in one]   # the CRC goes on after the first word and its space
    left, right = (distinct // max(1, len(names))).tolist(), (distinct % max(1, len(names))).tolist()
    two = np.fromiter((zlib.crc32(names[b], starts[a]) for a, b in zip(left, right)), np.int64, len(distinct))
    return (np.bincount(owner, minlength=len(texts)),
            np.concatenate([owner, owner[inside]]),
            np.concatenate([(one % buckets)[ids], (two % buckets)[pairs.indices.to_numpy()]]))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all ``text`` of a table."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(bucketed(part.column("text"), buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "c": total[at]})

    out = [0] * buckets
    for r in (texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, c long")
              .groupBy("bucket").agg(F.sum("c").alias("c")).collect()):
        out[r["bucket"]] = r["c"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """``floor(1000 * ln)`` of the smoothed ratio of shares, per bucket."""
    from math import floor, log

    b, s_all, t_all = len(source), sum(source), sum(target)
    return [floor(1000 * log(float(t + 1) * (s_all + b) / (float(s + 1) * (t_all + b)))) for s, t in zip(source, target)]


def weights(docs: DataFrame, table: list[int]) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row, weight the floored mean gain."""
    import numpy as np
    import pyarrow as pa

    gain = np.array(table, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, owner, bucket = bucketed(part.column("text"), len(gain))
                n = np.bincount(owner, minlength=part.num_rows)
                order = np.argsort(owner, kind="stable")
                taken, first = gain.take(bucket[order]), np.concatenate([[0], np.cumsum(n)[:-1]])
                total = np.zeros(part.num_rows, np.int64)
                some = n > 0
                if some.any():
                    total[some] = np.add.reduceat(taken, first[some])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": words.astype(np.int64),
                                                  "n_features": n.astype(np.int64), "weight": total // np.maximum(n, 1)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; undrawn rows have no rank."""
    table = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = cut_lineage(weights(docs, table).withColumn("score", F.col("weight") + gumbel), "resample-scores")
    fit = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["c"]) for r in rows.where(fit).groupBy("score").agg(F.count("*").alias("c")).collect()), reverse=True)
    draw, seen, cut = sum(c for _, c in counts) * percent // 100, 0, None
    for score, c in counts:
        if seen >= draw:
            break
        seen, cut = seen + c, score
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = fit & (F.col("score") >= cut)
    ranked = numbered(rows.where(high), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank").withColumn("rank", F.col("rank") + 1)
    return (ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
            .unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long"))))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
with recursive crc_step as (
  select i as code, i as c, 0 as bit from range(256) r(i)
  union all
  select code, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, bit + 1 from crc_step where bit < 8),
crc as (select list(c order by code) as t from crc_step where bit = 8),
texts as (
  select 'd' as side, row_number() over () as row, doc_id, text from documents
  union all select 't', row_number() over (), null, text from benchmark),
words as (
  select side, row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from texts),
features as (
  select side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words),
distinct_features as (select f, hex(encode(f)) as x from (select distinct f from features)),
bucket_of as (
  select f, cast(xor(list_reduce(list_concat([cast(4294967295 as bigint)],
                                             list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))),
                                 lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 as integer) as bucket
  from distinct_features, crc),
counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from features join bucket_of using (f) group by bucket),
totals as (select sum(s) as s_all, sum(t) as t_all from counts),
gain as (
  select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * cast(t2.s_all + 10000 as double) / (cast(s + 1 as double) * cast(t2.t_all + 10000 as double)))) as bigint) as g
  from counts, totals t2),
weight as (
  select row, count(*) as n_features, cast(floor(sum(g) / count(*)) as bigint) as weight
  from features join bucket_of using (f) join gain using (bucket) where side = 'd' group by row),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score
  from words left join weight using (row) where side = 'd'),
ranked as (
  select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) end as r,
         count(*) filter (n_words >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when r <= 25 * n // 100 then r end as rank from ranked"""
