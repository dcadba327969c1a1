"""Exact top-k search by columnar branch and bound (operator 1).

Vectors become integers (floor of 256 times each component) and are stored in blocks in
vertical layout: one row of a block's matrix holds one dimension of all its vectors. Per
query, scores accumulate one block of dimensions at a time. After each, the mass that is
left bounds what a vector can still gain or lose: the rest of the inner product lies
within the product of the two remaining norms. Vectors whose upper bound is below the
k-th best lower bound are dropped and the surviving columns are compacted. Ties survive,
so the result is exact while scores stay within 64 bits.

Queries (a stated set of rows) are dealt to blocks of about ``QUERY_VALUES`` numbers, so one
block holds all queries until there are many. A candidate block crosses the shuffle once per
query block, to one of the block's parts; a part's task reads its queries once and then
streams candidate blocks past them. Each query's k-th best score so far is carried from block
to block and prunes the next one from its first dimensions on. Only k rows per query and part
leave a task; a window keeps the best k of them. Numbers travel in 16 bits where they fit.
Only two numbers about the queries reach the driver, and nothing is broadcast.

Edge cases: vectors that are null or hold null or non-finite components take no part;
missing trailing dimensions count as zero; equal vectors tie by smaller id; a row of the
query's own id is never its result; candidates with one id count as one row each, queries
equal in id and vector once; vectors of any length (blocks are cut by numbers, not rows); rows
without an id take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE = 5, 256
QUERY_VALUES, CANDIDATE_VALUES, DIMS = 1 << 20, 1 << 18, 8
_BLOCK = "block long, n int, dims int, width string, ids binary, cols binary"


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v")))


def _packed(matrix):
    """The narrowest whole-number type that holds a matrix, and its bytes."""
    import numpy as np

    top = int(np.abs(matrix).max(initial=0))
    width = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return width, matrix.astype(width).tobytes()


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows as vertical blocks of about ``CANDIDATE_VALUES`` numbers, cut where the rows are read."""
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, ids, vectors, count = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            nonlocal k, ids, vectors, count
            dims = max(map(len, vectors))
            cols = np.zeros((dims, len(vectors)), dtype=np.int64)
            for j, v in enumerate(vectors):
                cols[: len(v), j] = v
            width, raw = _packed(cols)
            k += 1
            out = pd.DataFrame({"block": [part * 1_000_000 + k], "n": [len(ids)], "dims": [dims], "width": [width],
                                "ids": [np.array(ids, np.int64).tobytes()], "cols": [raw]})
            ids, vectors, count = [], [], 0
            return out

        for b in batches:
            for i, v in zip(b["vec_id"].tolist(), b["v"], strict=True):
                ids.append(i)
                vectors.append(v)
                count += max(1, len(v))
                if count >= CANDIDATE_VALUES:
                    yield block()
        if ids:
            yield block()

    return rows.mapInPandas(run, _BLOCK)


def search_block(q, qid, cols, ids, k: int, rest_c, dims: int = DIMS, floor=None):
    """Best k (ids, scores) of one block for query ``q``, by score, ties to the smaller id.

    ``cols`` is (dimensions x vectors), ``rest_c`` its ``suffix_norms``. Vectors that cannot
    reach ``floor``, a score that k others have, are left out.
    """
    import numpy as np

    alive = np.flatnonzero(ids != qid)
    width = cols.shape[0]
    if not len(alive) or k < 1:
        return ids[:0], ids[:0]
    score = np.zeros(len(alive), dtype=np.int64)
    q_sq = np.concatenate([np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], [0.0]])
    for step, at in enumerate(range(0, width, dims)):
        stop = min(at + dims, width)
        part = cols[at:stop] if len(alive) == cols.shape[1] else cols[at:stop][:, alive]
        score = score + q[at:stop] @ part
        slack = np.sqrt(q_sq[stop]) * rest_c[step + 1][alive]
        slack = slack * (1 + 1e-9) + 1e-6
        bound = floor
        if len(alive) > k:
            low = score - slack
            own = np.partition(low, len(low) - k)[len(low) - k]
            bound = own if bound is None else max(bound, own)
        if bound is not None:
            keep = score + slack >= bound
            if not keep.all():
                alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order]


def suffix_norms(cols, dims: int):
    """Norm of each vector's dimensions from each step on (computed once per block)."""
    import numpy as np

    sq = cols.astype(np.float64) ** 2
    tail = [np.zeros(cols.shape[1])]
    for at in reversed(range(0, cols.shape[0], dims)):
        tail.append(tail[-1] + sq[at: at + dims].sum(axis=0))
    return [np.sqrt(t) for t in reversed(tail)]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products per query row id."""
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession
    rows = _usable(queries).distinct()
    count, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-(count * max(1, dims or 1)) // QUERY_VALUES))
    # Enough (query block, part) keys for all tasks; a query block is repeated once per part.
    parts = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    asked = rows.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(-1).cast("long").alias("block"), F.col("vec_id").alias("qid"),
        F.col("v").alias("q"),
        none("int", "n"), none("int", "dims"), none("string", "width"), none("binary", "ids"), none("binary", "cols"))
    met = _blocks(_usable(candidates)).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("qblock"),
        F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block", none("long", "qid"), none("array<long>", "q"),
        "n", "dims", "width", "ids", "cols")
    stream = asked.unionByName(met).repartition("qblock", "part").sortWithinPartitions("qblock", "part", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, qids, vectors, best = None, [], [], []

        def found():
            sizes = [len(b[0]) for b in best]
            if sum(sizes):
                yield pd.DataFrame({"query_id": np.repeat(np.array(qids, np.int64), sizes), "vec_id": np.concatenate([b[0] for b in best]),
                                    "score": np.concatenate([b[1] for b in best])})

        none = np.empty(0, np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.qblock, r.part) != key:
                    yield from found()
                    key, qids, vectors, best = (r.qblock, r.part), [], [], []
                if r.block < 0:
                    qids.append(int(r.qid))
                    vectors.append(np.asarray(r.q, np.int64))
                    best.append((none, none))
                    continue
                dims, n = int(r.dims), int(r.n)
                cols = np.frombuffer(r.cols, r.width).reshape(dims, n).astype(np.int64)
                ids, rest = np.frombuffer(r.ids, np.int64), suffix_norms(cols, DIMS)
                for j, (qid, v) in enumerate(zip(qids, vectors, strict=True)):
                    q = np.zeros(dims, np.int64)   # dimensions beyond the shorter vector add nothing
                    q[: len(v)] = v[:dims]
                    have = best[j]
                    got = search_block(q, qid, cols, ids, k, rest, floor=have[1][-1] if len(have[0]) == k and k else None)
                    if len(got[0]):
                        i, s = np.concatenate([have[0], got[0]]), np.concatenate([have[1], got[1]])
                        order = np.lexsort((i, -s))[:k]
                        best[j] = (i[order], s[order])
        yield from found()

    found = stream.select("qblock", "part", "block", "qid", "q", "n", "dims", "width", "ids", "cols").mapInPandas(
        run, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_vector_topk(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
           from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
