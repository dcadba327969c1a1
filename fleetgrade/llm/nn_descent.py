"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 13).

Index. Equal vectors are one node. Each of ``ORDERS`` orders sorts all nodes by their nearest
pivot (at most ``PIVOTS`` sampled vectors, another sample in each order, themselves ordered as a
chain of near ones) and cuts them into blocks of at most ``CELL`` consecutive nodes, which mostly
lie near each other. Largest inner product becomes
nearest neighbour by one more component, ``sqrt(M^2 - |x|^2)`` (M: the greatest norm), with
which all nodes have the same norm. NN-descent runs in every block of every order: lists start
from the leaves of ``TREES`` random projection trees; in each round a node's list (its ``START``
nearest so far and up to ``REVERSE`` nodes that list it) has all its pairs with a new member
scored, and the best ``START`` of each node stay. Rounds end when no more than ``SETTLED`` of a
block's edges are new. What the orders found for a node is merged to its ``DEGREE`` nearest. So a vector
travels once per order, whatever the size of the table.

Rounds over the whole graph follow (``build(across=True)``, as ``nearest`` does), so that nodes meet
that are near in no order: a node's list meets the vectors
it names in the cell of the node (``CELL`` consecutive numbers), all pairs of one list with a new
member are scored there, and those better than
what an end has go to that end's cell, where the best ``DEGREE`` stay. Rounds end when no more than
``SETTLED`` of all edges are new. This takes each vector to
each cell that names it in every round: to all cells, until there are more of them than places
in lists (``DEGREE + REVERSE`` at most). While a table has no more vectors than one cell may name,
``JOINT`` cells are joined in one task, which halves the copies in the same room.

``REVERSE`` bounds how many of the nodes that list a hub are compared with each other through
it in one round (the nearest ones are); their own edges to the hub stay, and they meet its
neighbours through those. No vector is left out of the index.

Search. Equal query vectors are searched once. A query starts from the ``STARTS`` best of
``ENTRIES`` sampled nodes and, where its vector is indexed, from that node; it keeps a beam of ``BEAM``
nodes and in each step scores the neighbours of all beam nodes not yet expanded, until none
is left. Queries work in blocks of bounded size; adjacency and vectors come to a block by
joins, once per block. The best nodes are scored again on the original vectors in double
precision. Recall against brute force on the given embeddings is in the README and tested.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components take no
part, nor do rows without vec_id; missing trailing components count as zero; rows equal in id
and vector count once; rows that share an id but not the vector are queries of their own, as
candidates they count by the best of them, and a query never returns its own id; equal scores tie by smaller vec_id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrade.functions.numbering import numbered
from fleetgrade.session import cut_lineage

K = 20
CELL, DEGREE, REVERSE, SETTLED = 4_096, 48, 24, 0.08
ORDERS, TREES, LEAF, START, JOINED = 16, 3, 256, 24, 128    # JOINED: lists of a block joined at once
JOINT = 2                             # cells joined at once while all vectors fit in one
BEAM, ENTRIES, STARTS, QUERY_BLOCK, SPARE = 128, 512, 8, 2_048, 12
PIVOTS, PIVOT_VALUES = 512, 1 << 17   # sampled vectors per order, and their numbers in all
SORTED = 400_000                      # edges that are sorted at once

# Edges of a cell's nodes in one row per kind: its lists (0), what other cells say to its nodes (1), the
# last score of its full lists (2), and what a round found for them (3).
_PACK = "cell long, kind int, owners array<long>, ids array<long>, scores array<float>, fresh array<boolean>"


@dataclass
class Index:
    rows: DataFrame       # vec_id, embedding: all usable rows, equal ones once
    nodes: DataFrame      # node, embedding, vec (float32 with the added component)
    graph: DataFrame      # node, ids: the nearest nodes
    scale: float          # the greatest norm
    dims: int


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))


def _square(v):
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _edges(rows):
    """Owners, ids, scores and fresh marks of packed rows, each in one array."""
    import numpy as np

    return tuple(np.concatenate([np.asarray(x, t) for x in rows[c]]) if len(rows) else np.empty(0, t)
                 for c, t in (("owners", np.int64), ("ids", np.int64), ("scores", np.float32), ("fresh", bool)))


def best_of(owner, ids, scores, fresh, k: int):
    """The ``k`` best distinct ids per owner, best first; an id that is known already is not fresh.

    Many edges are sorted in parts of whole owners, since sorting takes several times their room.
    """
    import numpy as np

    if len(owner) <= SORTED:
        return _best_of(owner, ids, scores, fresh, k)
    values, n = np.unique(owner, return_counts=True)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // SORTED)) + 1
    done = []
    for part in np.split(values, cuts):
        at = np.flatnonzero((owner >= part[0]) & (owner <= part[-1]))
        done.append(_best_of(owner[at], ids[at], scores[at], fresh[at], k))
    return tuple(np.concatenate(c) for c in zip(*done))


def _best_of(owner, ids, scores, fresh, k: int):
    import numpy as np

    if len(owner) and max(owner.max(), ids.max()) < 1 << 31:   # one key sorts faster than three
        key = owner.astype(np.int64)
        key <<= 32
        key |= ids.astype(np.int64) << 1
        key |= fresh
        order = np.argsort(key).astype(np.int32 if len(key) < 1 << 31 else np.int64)
        del key
    else:
        order = np.lexsort((fresh, ids, owner))
    owner, ids, scores, fresh = owner[order], ids[order], scores[order], fresh[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, scores, fresh = owner[first], ids[first], scores[first].astype(np.float32), fresh[first]
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, bool)
    bits = scores.view(np.int32)                               # in the order of the scores, sign apart
    key = np.cumsum(new)
    key <<= 33
    key -= np.where(bits >= 0, bits, -(bits & 0x7FFFFFFF))
    order = np.argsort(key, kind="stable")
    del key, bits
    owner, ids, scores, fresh = owner[order], ids[order], scores[order], fresh[order]
    start = np.flatnonzero(new)
    place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = place < k
    return owner[keep], ids[keep], scores[keep], fresh[keep]


def _packs(kind, owner, ids, scores, fresh):
    """Edges in the order of their owners as one row per cell."""
    import numpy as np
    import pandas as pd

    if not len(owner):
        return pd.DataFrame(columns=["cell", "kind", "owners", "ids", "scores", "fresh"], dtype=object)
    cell = owner // CELL
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    cut = lambda a: np.split(a, at[1:])
    return pd.DataFrame({"cell": cell[at], "kind": np.full(len(at), kind, np.int32), "owners": cut(owner), "ids": cut(ids),
                         "scores": cut(scores.astype(np.float32)), "fresh": cut(fresh)})


def _scaled(embeddings, scale: float, dims: int, indexed: bool):
    """Vectors as float32 rows of one component more."""
    import numpy as np

    x = np.zeros((len(embeddings), dims + 1))
    for i, v in enumerate(embeddings):
        x[i, : min(len(v), dims)] = np.asarray(v, np.float64)[:dims] / scale
    if indexed:
        x[:, dims] = np.sqrt(np.maximum(0.0, 1.0 - (x[:, :dims] ** 2).sum(axis=1)))
    return x.astype(np.float32)


def _chain(x):
    """Rows of ``x`` in the order of a walk that goes on to the nearest row not yet visited."""
    import numpy as np

    near = x @ x.T
    order, free = [0], np.ones(len(x), bool)
    for _ in range(len(x) - 1):
        free[order[-1]] = False
        order.append(int(np.where(free, near[order[-1]], -np.inf).argmax()))
    return x[order]


def _pivots(vectors: DataFrame, scale: float, dims: int, orders: int) -> list:
    """Ordered pivots of each order: a bounded sample by a hash of the vectors."""
    some = min(PIVOTS, max(1, PIVOT_VALUES // (dims + 1)))
    rows = vectors.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(some * orders).collect()
    parts = [rows[t::orders] for t in range(orders)]
    return [_chain(_scaled([r["embedding"] for r in p or rows[:1]], scale, dims, True)) for p in parts] if rows else []


def _prepare(vectors: DataFrame, scale: float, dims: int, pivots: list) -> DataFrame:
    """``vec`` (float32, one component more) and the nearest pivot in each order for each ``embedding``."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            x = _scaled(b["embedding"], scale, dims, bool(pivots))
            codes = np.stack([(x @ p.T).argmax(axis=1) for p in pivots], axis=1) if pivots else np.zeros((len(b), 0), int)
            b["vec"], b["codes"] = [r.tobytes() for r in x], list(codes.astype(np.int64))
            yield pd.DataFrame(b)

    more = [T.StructField("vec", T.BinaryType()), T.StructField("codes", T.ArrayType(T.LongType()))]
    return vectors.mapInPandas(run, T.StructType([*vectors.schema.fields, *more]))


def _tree(x, rng):
    """Owners, ids and scores of the ``START`` nearest inside the leaves of a random projection tree."""
    import numpy as np

    def leaves(at):
        if len(at) <= LEAF:
            return [at]
        a, b = rng.choice(at, 2, replace=False)
        order = np.argsort(x[at] @ (x[a] - x[b]), kind="stable")
        half = len(at) // 2
        return [*leaves(at[order[:half]]), *leaves(at[order[half:]])]

    edges = []
    for at in leaves(np.arange(len(x))):
        score = x[at] @ x[at].T
        np.fill_diagonal(score, -np.inf)
        n = min(START, len(at) - 1)
        near = np.argpartition(-score, n - 1, axis=1)[:, :n] if n > 0 else np.empty((len(at), 0), int)
        edges.append((np.repeat(at, near.shape[1]), at[near].ravel(), np.take_along_axis(score, near, 1).ravel()))
    return tuple(np.concatenate(e) for e in zip(*edges))


def _table(owner, ids, fresh, n: int, k: int):
    """A row of ``k`` ids and fresh marks per owner; ``n`` stands in empty places."""
    import numpy as np

    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    members, marks = np.full((n, k), n), np.zeros((n, k), bool)
    members[owner, place], marks[owner, place] = ids, fresh
    return members, marks


def _descent(x, seed: int):
    """Owners, ids and scores of the ``START`` nearest that NN-descent among the rows of ``x`` finds."""
    import numpy as np

    n, rng = len(x), np.random.default_rng(seed)
    edges = [np.concatenate(c) for c in zip(*(_tree(x, rng) for _ in range(TREES)))]
    own, ids, score, fresh = best_of(*edges, np.ones(len(edges[0]), bool), START)
    padded = np.vstack([x, np.zeros_like(x[:1])])
    apart = ~np.eye(START + REVERSE, dtype=bool)
    while fresh.sum() > SETTLED * len(fresh):
        lister, listed, _, new = best_of(ids, own, score, fresh, REVERSE)
        more = ~np.isin(lister * n + listed, own * n + ids)          # not in the list already
        members, marks = (np.hstack(c) for c in zip(
            _table(own, ids, fresh, n, START), _table(lister[more], listed[more], new[more], n, REVERSE)))
        last = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        full = last[np.diff(np.append(-1, last)) >= START]
        worst = np.append(np.full(n, -np.inf, np.float32), np.float32(np.inf))
        worst[own[full]] = score[full]
        held, live = [(own, ids, score, np.zeros(len(own), bool))], np.flatnonzero(marks.any(axis=1))
        for lo in range(0, len(live), JOINED):
            at, mark = members[live[lo:lo + JOINED]], marks[live[lo:lo + JOINED]]
            scored = padded[at] @ padded[at].transpose(0, 2, 1)
            better = scored > worst[at][:, :, None]
            better &= (mark[:, :, None] | mark[:, None, :]) & (at < n)[:, None, :] & apart
            row, i, j = np.nonzero(better)
            held.append((at[row, i], at[row, j], scored[row, i, j], np.ones(len(row), bool)))
            if sum(len(h[0]) for h in held[1:]) > SORTED:
                held = [best_of(*(np.concatenate(c) for c in zip(*held)), START)]
        own, ids, score, fresh = best_of(*(np.concatenate(c) for c in zip(*held)), START)
    return own, ids, score


def _blocks(nodes: DataFrame, total: int) -> DataFrame:
    """``block, node, vec``: every node once per order, in blocks of at most ``CELL`` consecutive nodes of the order."""
    each = -(-total // CELL)
    orders = ORDERS if each > 1 else 1
    codes = nodes.select("node", F.posexplode(F.slice("codes", 1, orders)).alias("turn", "code"))
    block = F.expr(f"turn * {each} + (at % {total}) * {each} div {total}")     # an order has a row of every node
    return numbered(codes, ["turn", "code", "node"], "at").select(block.alias("block"), "node").join(nodes.select("node", "vec"), "node")


def _found(nodes: DataFrame, total: int) -> DataFrame:
    """What NN-descent finds in the blocks of all orders."""
    import numpy as np
    import pandas as pd

    def descend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        node = rows["node"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(len(rows), -1)
        own, ids, score = _descent(x, int(rows["block"].iloc[0]))
        return _packs(3, node[own], node[ids], score, np.ones(len(own), bool))

    return _blocks(nodes, total).groupBy("block").applyInPandas(descend, _PACK)


def _merged(graph: DataFrame | None, found: DataFrame, across: bool = True) -> DataFrame:
    """Lists (kind 0) with the found neighbours merged in, and what they say to others (kinds 1 and 2) for rounds across cells."""
    import numpy as np
    import pandas as pd

    rows = found if graph is None else found.unionByName(graph.where("kind = 0").withColumn("fresh", F.transform("fresh", lambda x: F.lit(False))))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        owner, ids, scores, fresh = best_of(*_edges(rows), DEGREE)
        if not across:
            return _packs(0, owner, ids, scores, fresh)
        back = best_of(ids, owner, scores, fresh, REVERSE)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.empty(0, int)
        full = last[np.diff(np.append(-1, last)) >= DEGREE]
        return pd.concat([_packs(0, owner, ids, scores, fresh), _packs(1, *back),
                          _packs(2, owner[full], owner[full], scores[full], fresh[full])])

    return rows.groupBy("cell").applyInPandas(merge, _PACK)


def _lists(rows):
    """Owners, ids and old marks of a cell's lists that have a fresh member, cut as they are joined."""
    import numpy as np

    parts = []
    for kind, most in ((0, DEGREE), (1, REVERSE)):
        own, ids, score, fresh = _edges(rows[rows["kind"] == kind])
        parts.append(best_of(own, ids, score, ~fresh, most))
    own, ids, score, old = (np.concatenate(p) for p in zip(*parts))
    own, ids, _, old = best_of(own, ids, score, old, DEGREE + REVERSE)
    if not len(own):
        return own, ids, old
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    live = np.repeat(np.logical_or.reduceat(~old, start), np.diff(np.append(start, len(own))))
    return own[live], ids[live], old[live]


def _joined(lists: DataFrame, nodes: DataFrame, cells: int = 1) -> DataFrame:
    """One round: pairs of each node's list that are better than what one of them has; ``cells`` neighbouring cells in one task."""
    import numpy as np
    import pandas as pd

    named = lists.where("kind < 2").withColumn("cell", F.expr(f"cell div {cells}"))

    def asked(rows: pd.DataFrame) -> pd.DataFrame:
        """Only what the cut lists name: other cells say up to REVERSE ids each of a hub."""
        return pd.DataFrame({"home": int(rows["cell"].iloc[0]), "node": np.unique(_lists(rows)[1])}, dtype=np.int64)

    need = named.groupBy("cell").applyInPandas(asked, "home long, node long")
    worst = lists.where("kind = 2").select(F.explode(F.arrays_zip("owners", "scores")).alias("e")).select(
        F.col("e.owners").alias("node"), F.col("e.scores").alias("worst"))
    vectors = need.join(worst, "node", "left").join(nodes.select("node", "vec"), "node")

    def pairs(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own, ids, old = _lists(rows)
        if not len(own):
            return _packs(3, own, ids, np.empty(0, np.float32), old)
        known = known.sort_values("node")
        node = known["node"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(known["vec"]), np.float32).reshape(len(known), -1)
        worst = known["worst"].fillna(-np.inf).to_numpy(np.float32, copy=True)
        at = np.searchsorted(node, ids).astype(np.int32)      # local places take half the room
        del ids
        start = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
        held, count, kept = [], 0, 0

        def shrink():
            """Keep the best per node, and ask as much of later pairs as a full list does already."""
            whole = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            o, i, s, _ = best_of(*whole, np.ones(count, bool), DEGREE + 1)  # a node meets itself, too
            last = np.flatnonzero(np.append(o[1:] != o[:-1], True))
            full = np.diff(np.append(-1, last)) > DEGREE
            worst[o[last[full]]] = np.maximum(worst[o[last[full]]], s[last[full]])
            return [(o, i, s)]

        for lo, hi in zip(start[:-1], start[1:]):
            a = at[lo:hi]
            b = a[~old[lo:hi]]
            score = x[b] @ x[a].T
            bar = worst[a]
            for left, right, s, better in ((b, a, score, score > worst[b][:, None]), (a, b, score.T, (score > bar[None, :]).T)):
                i, j = np.nonzero(better)
                held.append((left[i], right[j], s[i, j]))
                count += len(i)
            if count > kept + 400_000:
                held = shrink()
                count = kept = len(held[0][0])
        if not count:
            return _packs(3, own[:0], own[:0], np.empty(0, np.float32), old[:0])
        o, i, s = shrink()[0]
        other = o != i
        return _packs(3, node[o[other]], node[i[other]], s[other], np.ones(int(other.sum()), bool))

    return named.groupBy("cell").cogroup(vectors.groupBy("home")).applyInPandas(pairs, _PACK)


def _adjacency(lists: DataFrame) -> DataFrame:
    """``node, ids`` of the lists."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            for owners, ids in zip(b["owners"], b["ids"], strict=True):
                at = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))    # packed rows hold an edge at least
                yield pd.DataFrame({"node": owners[at], "ids": np.split(ids, at[1:])})

    return lists.where("kind = 0").select("owners", "ids").mapInPandas(run, "node long, ids array<long>")


def build(vectors: DataFrame, across: bool = False) -> Index:
    """The index over all usable rows of ``vectors`` (vec_id, embedding); ``across``: with rounds over the whole graph."""
    rows = cut_lineage(usable(vectors).distinct(), "ann-rows")
    r = rows.agg(F.max(_square("embedding")), F.max(F.size("embedding"))).first()
    scale, dims = float(r[0] or 1.0) ** 0.5, int(r[1] or 1)
    same = cut_lineage(rows.groupBy("embedding").agg(F.min("vec_id").alias("low")), "ann-same")
    nodes = cut_lineage(numbered(_prepare(same, scale, dims, _pivots(same, scale, dims, ORDERS)), [F.get("codes", F.lit(0)), "low"], "node"), "ann-nodes")
    total = nodes.count()
    lists = cut_lineage(_merged(None, _found(nodes, max(1, total)), across), "ann-graph")
    cells = JOINT if total <= CELL * (DEGREE + REVERSE) else 1
    while across:
        edges = lists.where("kind = 0").agg(F.sum(F.size("ids")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if (edges[1] or 0) <= SETTLED * (edges[0] or 0):
            break
        lists = cut_lineage(_merged(lists, _joined(lists, nodes, cells)), "ann-graph")
    return Index(rows, nodes.select("node", "embedding", "vec"), cut_lineage(_adjacency(lists), "ann-adjacency"), scale, dims)


def _near_nodes(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``query, node``: the best nodes of greedy search for every query (query, embedding)."""
    import numpy as np
    import pandas as pd

    total = index.nodes.count()
    if not total:
        return queries.select("query", F.lit(0).cast("long").alias("node")).where("false")
    step = max(1, total // ENTRIES)
    sample = index.nodes.where(F.col("node") % step == 0).select("node", "vec").limit(2 * ENTRIES).collect()
    entry = np.array([r["node"] for r in sample], np.int64)
    entry_x = np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), np.float32).reshape(len(sample), -1)
    beam = max(BEAM, 4 * k)

    def start(batches):
        for b in batches:
            q = np.frombuffer(b"".join(b["vec"]), np.float32).reshape(len(b), -1)
            score = q @ entry_x.T
            near = np.argsort(-score, axis=1, kind="stable")[:, :STARTS]
            yield pd.DataFrame({"query": b["query"], "vec": b["vec"], "near": entry[near[:, 0]], "ids": list(entry[near]),
                                "scores": list(np.take_along_axis(score, near, 1))})

    ready = _prepare(queries, index.scale, index.dims, []).drop("codes")
    own = ready.join(index.nodes.select("embedding", F.col("node").alias("own")), "embedding", "left")
    begun = own.select("query", "vec").mapInPandas(start, "query long, vec binary, near long, ids array<long>, scores array<float>")
    begun = begun.join(own.select("query", "own"), "query").select(
        F.coalesce("own", "near").alias("near"), "query", "vec", "ids", "scores", "own")
    # An indexed query's own node stands in the first beam with the score 1 until it is expanded.
    block = F.floor(F.col("place") / F.lit(QUERY_BLOCK)).alias("block")
    mine = F.col("own").isNotNull() & ~F.array_contains("ids", F.coalesce("own", F.lit(-1)))
    now = cut_lineage(numbered(begun, ["near", "query"], "place").select(
        block, "query", "vec", F.when(mine, F.concat("ids", F.array("own"))).otherwise(F.col("ids")).alias("ids"),
        F.when(mine, F.concat("scores", F.array(F.lit(1.0).cast("float")))).otherwise(F.col("scores")).alias("scores"))
        .withColumn("open", F.transform("ids", lambda x: F.lit(True))), "ann-beams")

    def expand(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        links = known[known["kind"] == 0]
        edges = dict(zip(links["node"].tolist(), links["ids"], strict=True))
        vecs = known[known["kind"] == 1].sort_values("node")
        node = vecs["node"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(vecs["vec"]), np.float32).reshape(len(vecs), -1) if len(vecs) else None
        out = []
        for block, query, vec, ids, scores, todo in rows[["block", "query", "vec", "ids", "scores", "open"]].itertuples(index=False):
            if any(todo):
                seen = [edges[i] for i, t in zip(ids.tolist(), todo.tolist()) if t and i in edges]
                new = np.setdiff1d(np.concatenate(seen), ids) if seen else np.empty(0, np.int64)
                score = x[np.searchsorted(node, new)] @ np.frombuffer(vec, np.float32) if len(new) else np.empty(0, np.float32)
                scores, todo = np.concatenate([scores, score]), np.concatenate([np.zeros(len(ids), bool), np.ones(len(new), bool)])
                ids = np.concatenate([ids, new])
                order = np.lexsort((ids, -scores))[:beam]
                ids, scores, todo = ids[order], scores[order].astype(np.float32), todo[order]
            out.append((block, query, vec, ids, scores, todo))
        return pd.DataFrame(out, columns=["block", "query", "vec", "ids", "scores", "open"])

    while True:
        live = now.where(F.exists("open", lambda t: t))
        if live.isEmpty():
            break
        ahead = F.explode(F.arrays_zip("ids", "open")).alias("e")
        ask = live.select("block", ahead).where("e.open").select("block", F.col("e.ids").alias("node")).distinct()
        links = cut_lineage(ask.join(index.graph, "node").select("block", "node", "ids"), "ann-ask")
        need = links.select("block", F.explode("ids").alias("node")).distinct().join(index.nodes.select("node", "vec"), "node")
        known = links.select("block", F.lit(0).alias("kind"), "node", "ids", F.lit(None).cast("binary").alias("vec")).unionByName(
            need.select("block", F.lit(1).alias("kind"), "node", F.lit(None).cast("array<long>").alias("ids"), "vec"))
        now = cut_lineage(now.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(expand, now.schema), "ann-beams")
    return now.select("query", F.explode(F.slice("ids", 1, k + SPARE)).alias("node"))


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each row of ``queries`` (vec_id, embedding)."""
    asked = usable(queries).distinct()
    # Equal query vectors are one query; its ids come back at the end.
    vectors = cut_lineage(numbered(asked.groupBy("embedding").agg(F.min("vec_id").alias("low")), ["low", "embedding"], "query"), "ann-queries")
    near = _near_nodes(index, vectors.select("query", "embedding"), k)
    # Of equal vectors only the k + 1 smallest ids can be among k nearest.
    by = Window.partitionBy("embedding").orderBy("vec_id")
    members = (index.rows.withColumn("copy", F.row_number().over(by)).where(F.col("copy") <= k + 1)
               .join(index.nodes.select("node", "embedding"), "embedding"))
    product = F.aggregate(F.zip_with("q", "embedding", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))),
                          F.lit(0.0), lambda s, x: s + x)
    scored = (near.join(vectors.select("query", F.col("embedding").alias("q")), "query").join(members, "node")
              .select("query", "vec_id", product.alias("score")))
    # One more than k per query vector, as its own id goes; an id with several vectors counts its best.
    scored = scored.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    top = (scored.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("query")
           .agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top")))
    ids = asked.join(vectors.select("query", "embedding"), "embedding").select("query", F.col("vec_id").alias("query_id"))
    mine = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return (ids.join(top, "query").select("query_id", F.posexplode(mine).alias("at", "e"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score")))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """Build the index over ``candidates`` and search it for ``queries``."""
    return search(build(candidates, across=True), queries, k)


def op13_nn_descent(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors)
