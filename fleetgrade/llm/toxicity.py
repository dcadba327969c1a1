"""Toxicity: FTRL-proximal logistic regression over hashed n-grams (operator 3).

Features of a text are its distinct words, word pairs and pairs with one word skipped, and
the first STEM bytes of longer words (a plain stem, so inflected forms share a weight),
hashed into 2^BITS coordinates. FTRL-proximal gives each coordinate its own learning rate,
and its L1 term leaves most weights at exactly zero, so the model is a short list of
(coordinate, weight) that travels with the scoring function (at most 2^BITS entries).

Fitting: labelled rows outside the held-out fold, at most about ``FIT_ROWS`` of them
(documented bound; taken by a hash of doc_id, all if fewer), are cut into shards of
``SHARD_ROWS``; every shard is fitted on its own and the weights are averaged, so no task
sees more than one shard. Scoring: every row of the table, whole text, where it is read.
Labels, language, source and doc_id are never features.

Edge cases: null and empty texts get the score of the intercept; a document with several
label rows counts as toxic if any says so; null labels are left out; without labelled rows
every score is the intercept's 0.5 less a hair (predicted 0); repeated rows are scored row by row;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.llm.common import remainder
from fleetgrade.llm.licenses import plain_words

BITS = 20
STEM = 5
FIT_ROWS, SHARD_ROWS = 16_000, 16_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1.0, 0.1, 4
FOLD = 5
_MEMO: dict[bytes, int] = {}


def features(text: str | None, bits: int = BITS):
    """Sorted distinct coordinates of a text."""
    import numpy as np
    import xxhash

    ws = plain_words(text)
    memo, digest = _MEMO, xxhash.xxh64_intdigest
    if len(memo) > 500_000:
        memo.clear()
    h = np.fromiter((memo.get(w) or memo.setdefault(w, digest(w) | 1) for w in ws), dtype=np.uint64, count=len(ws))
    stem = np.fromiter((memo.get(w) or memo.setdefault(w, digest(w) | 1) for w in {w[:STEM] for w in ws if len(w) > STEM}),
                       dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    parts = [h, stem ^ np.uint64(0x5851F42D4C957F2D)]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            a, b = h[:-gap], h[gap:]
            parts.append((a * mix + np.uint64(gap)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)))
        allf = np.concatenate(parts) * mix
    return np.unique(allf >> np.uint64(64 - bits)).astype(np.int64)


def fit_shard(rows, bits: int = BITS):
    """FTRL-proximal over one shard of (coordinates, label); returns (weights, intercept)."""
    import numpy as np

    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i, y in rows:
            w = weights(i)
            b = -zb / ((BETA + nb ** 0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = p - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / ALPHA * b
            nb += g * g
    return weights(np.arange(1 << bits)), -zb / ((BETA + nb ** 0.5) / ALPHA)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> tuple:
    """(coordinates, weights, intercept) from labelled rows outside the held-out fold."""
    import numpy as np
    import pandas as pd

    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(FOLD) != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    part = FIT_ROWS / max(1, known.count())
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    known = known.where(turn < int(1_000_000 * min(1.0, part)))
    shards = max(1, FIT_ROWS // SHARD_ROWS)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["doc_id", "text"])
        order = order.iloc[np.random.default_rng(7).permutation(len(order))]
        w, b = fit_shard([(features(t, bits), y) for t, y in zip(order["text"], order["toxic"], strict=True)], bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], b)})

    # Equal rows teach once; where ids hold many different texts, rows are sampled as well.
    rows = docs.select("doc_id", "text").join(known, "doc_id").withColumn("_h", F.xxhash64("text"))
    keys = rows.select("doc_id", "_h").distinct().count()
    if keys > 2 * FIT_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "_h"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / keys))
    fitted = (rows.groupBy("doc_id", "_h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
              .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))
              .groupBy("shard").applyInPandas(shard, "at long, w double"))
    model = fitted.groupBy("at").agg((F.sum("w") / shards).alias("w")).toPandas().sort_values("at")
    own = model[model["at"] >= 0]
    bias = float(model.loc[model["at"] == -1, "w"].sum()) if len(model) else -1e-9
    return own["at"].to_numpy(np.int64), own["w"].to_numpy(np.float64), bias


def score(docs: DataFrame, model: tuple, bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    import numpy as np
    import pandas as pd

    at, w, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(1 << bits)
        dense[at] = w
        for b in batches:
            total = np.array([dense[features(t, bits)].sum() for t in b["text"]]) + bias
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"],
                                "score": 1 / (1 + np.exp(-np.clip(total, -30, 30)))})

    return (docs.select("doc_id", "text", (remainder(FOLD) == 0).alias("held_out"))
            .mapInPandas(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
