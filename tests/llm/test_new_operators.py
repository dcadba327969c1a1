"""Collocations, resampling and neighbour search against plain versions; mixing, class model and pipeline as a whole."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetgrade.llm import (class_lm, collocations, common, jaccard_join, licenses, mixing, nn_descent, pii, quality, resampling,
                            sentencepiece_bpe, toxicity, vector_topk)
from tests.conftest import SF01
from tests.llm.test_operators import ODD, _groups, _python_spans, odd  # noqa: F401


# --- collocations ------------------------------------------------------------------------------------------

def _plain_collocations(docs, least, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    counts["und" if lang is None else lang][tuple(w[i: i + m])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        rows = []
        for k, a in cand.items():
            if any(len(x) > len(k) and 100 * v >= 80 * a and any(x[i: i + len(k)] == k for i in range(len(x))) for x, v in cand.items()):
                continue
            s, _, left, right = min((2_000_000 * a // (c[k[:j]] + c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            rows.append((-s, -a, " ".join(k).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("small", [{}, dict(BLOCK_TOKENS=300, HELD=40, SPLIT=30, BURST=5), dict(BLOCK_TOKENS=97, HELD=20, SPLIT=7, BURST=3)])
def test_collocations_equal_plain_counts(spark, monkeypatch, small):
    random.seed(3)
    vocabulary = ["a", "b", "The", "cat", "sat", "é", "x\x01", "z"]
    docs = [(random.choice(["en", "de", None]), random.choice([" ", "\t"]).join(
        random.choices(vocabulary, [9, 6, 4, 2, 2, 1, 1, 1], k=random.randint(0, 80))) + random.choice([".", "\n", "", ", "])) for _ in range(60)]
    docs += [("en", None), ("de", ""), ("en", "The cat sat " * 200), ("en", "The cat sat " * 200)]
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted(tuple(r) for r in collocations.collocations(df, 5).collect()) == _plain_collocations(docs, 5)
    assert sorted(tuple(r) for r in collocations.collocations(df, 5, 7).collect()) == _plain_collocations(docs, 5, 7)


def test_trie_bursts_and_spills_whole_subtrees():
    random.seed(1)
    trie, want = collocations.HatTrie(burst=4), collections.Counter()
    got = collections.Counter()
    for step in range(30):
        rows = [(random.randint(1, 4), random.randint(1, 9) << 42 | random.randint(0, 3) << 21) for _ in range(50)]
        trie.add(*map(list, zip(*rows)))
        want.update(rows)
        size = trie.tidy()
        assert size == {a: len({s for b, s in want if b == a and (b, s) not in got or b == a and want[b, s] > got[b, s]}) for a in trie.root}
        if step % 7 == 6:
            a = max(size, key=size.get)
            first, rest, count = trie.spill([a])
            assert (np.diff(rest) > 0).all() and set(first) == {a}
            got.update({(int(x), int(y)): int(n) for x, y, n in zip(first, rest, count)})
    first, rest, count = trie.spill(trie.root)
    for x, y, n in zip(first, rest, count):
        got[int(x), int(y)] += int(n)
    assert got == want and not trie.root


# --- resampling --------------------------------------------------------------------------------------------

def _plain_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower) if x]
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def _plain_resample(docs, target, least=20):
    source, goal = collections.Counter(), collections.Counter()
    for _, t in docs:
        source.update(_plain_features(t)[1])
    for t in target:
        goal.update(_plain_features(t)[1])
    s_all, t_all, out = sum(source.values()), sum(goal.values()), []
    for i, t in docs:
        n, f = _plain_features(t)
        g = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in f]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, fit[: len(fit) * 25 // 100]


def test_resampling_equals_plain_version(spark, odd, monkeypatch):  # noqa: F811
    random.seed(9)
    words = ["alpha", "Beta", "γάμμα", "x1", "42", "été", "don't", "semi;colon", "😀"]
    more = [(100 + i, " ".join(random.choices(words, k=random.randint(0, 60)))) for i in range(80)]
    docs = ODD + more
    target = ["alpha beta x1 x1", "", None, "été 😀"]
    df = odd.select("doc_id", "text", "n").union(spark.createDataFrame([(i, t, 0) for i, t in more], "doc_id long, text string, n int"))
    monkeypatch.setattr(resampling, "SLICE_CHARS", 2000)
    got = resampling.resample(df.withColumn("rank", F.lit("clash")), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, drawn = _plain_resample(docs, target)
    assert collections.Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == collections.Counter(want)
    ranked = sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None)
    assert ranked == [(i + 1, r[0], r[4]) for i, r in enumerate(drawn)]
    empty = df.where("false")
    assert resampling.resample(empty, empty).count() == 0
    assert {r["rank"] for r in resampling.resample(df.where("doc_id < 5"), empty).collect()} == {None}


def test_resampling_prefers_the_target(spark):
    random.seed(4)
    docs = [(i, " ".join(random.choices(["stone", "river", "cloud", "tree"] if i % 2 else ["tax", "law", "court", "code"], k=30))) for i in range(400)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame([("river stone tree cloud " * 20_000,)], "text string")).where("rank is not null").collect()
    assert len(got) == 100 and sum(r.doc_id % 2 for r in got) >= 90


# --- neighbours --------------------------------------------------------------------------------------------

def _nearest(rows, queries, k):
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)})
    best = {}
    for q, a in ((i, v) for i, v in usable if queries(i)):
        score = collections.defaultdict(lambda: -math.inf)
        for i, b in usable:
            if i != q:
                score[i] = max(score[i], sum(x * y for x, y in zip(a, b)))
        best[q] = sorted((-s, i) for i, s in score.items())[:k]
    return best


def test_neighbours_recall_on_the_table(spark):
    vectors = common.table(spark, SF01, "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    want = _nearest(rows, lambda i: i % 20 == 0, 20)
    got = collections.defaultdict(dict)
    for r in nn_descent.op13_nn_descent(spark, SF01).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hit = sum(len({i for _, i in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values())) and set(got) == set(want)
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21)) and [ranks[i] for i in sorted(ranks)] == sorted(ranks.values(), key=lambda x: (-x[1], x[0]))


def test_neighbours_of_many_cells(spark, monkeypatch):
    """Cells, blocks and lists far smaller than in production, so that every join crosses them."""
    for name, value in dict(CELL=64, DEGREE=24, REVERSE=12, LEAF=32, START=12, QUERY_BLOCK=16, ENTRIES=32, BEAM=64).items():
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 12))
    rows = [(i, [float(x) for x in centres[i % 8] * (1 + i % 3) + 0.3 * rng.standard_normal(12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = _nearest(rows, lambda i: i % 20 == 0, 5)
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(df.where("vec_id % 20 = 0"), df, 5).collect():
        got[r.query_id].add(r.vec_id)
    hit = sum(len({i for _, i in want[q]} & got[q]) for q in want)
    print("recall", hit / sum(map(len, want.values())))
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_neighbours_odd_rows(spark):
    same = [0.5, 0.5, 0.0]
    rows = [(i, same) for i in range(60)] + [(100, [1.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (101, None), (102, []), (103, [0.0, 0.0]),
            (104, [None, 1.0]), (105, [float("nan")]), (106, [float("inf")]), (None, same), (120, [0.25]), (120, [0.0, 3.0]), (140, [1e-30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("score", F.lit("x"))
    want = _nearest(rows, lambda i: i % 20 == 0, 20)
    got = collections.defaultdict(dict)
    for r in nn_descent.nearest(df.where("vec_id % 20 = 0"), df).collect():
        if r.query_id == 120:       # two vectors under one id are two queries
            continue
        assert r["rank"] not in got[r.query_id]
        got[r.query_id][r["rank"]] = (round(-r.score, 6), r.vec_id)
    for q in (0, 20, 40, 100, 140):
        assert [got[q][i + 1] for i in range(20)] == [(round(s, 6) + 0.0, i) for s, i in want[q]]
    assert nn_descent.nearest(df.where("false"), df).count() == 0
    assert nn_descent.nearest(df, df.where("false")).count() == 0
    assert nn_descent.nearest(df.where("vec_id = 100"), df.where("vec_id = 100")).count() == 0


def test_many_edges_are_sorted_in_parts(monkeypatch):
    """Sorted in parts of whole owners, edges give the same lists in less room, also around a hub."""
    rng = np.random.default_rng(4)
    n = 1_000_000
    owner = np.where(rng.random(n) < 0.1, 77, rng.integers(0, 20_000, n)).astype(np.int32)
    ids = rng.integers(0, 3_000, n).astype(np.int32)
    scores, fresh = np.sin(owner * 3_001.0 + ids).astype(np.float32), rng.random(n) < 0.5
    monkeypatch.setattr(nn_descent, "SORTED", 10 * n, raising=False)
    want = nn_descent.best_of(owner, ids, scores, fresh, 24)
    monkeypatch.setattr(nn_descent, "SORTED", 60_000, raising=False)
    tracemalloc.start()
    got = nn_descent.best_of(owner, ids, scores, fresh, 24)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(want, got, strict=True))
    print("peak MB", peak)
    assert peak < 25


def test_a_round_asks_only_for_vectors_it_pairs(spark, monkeypatch):
    """A hub that 20 cells list asks for the REVERSE nearest of them, not for as many of each cell; settled lists ask for none."""
    cells, each, size = 20, 30, nn_descent.CELL
    edges = [(c * size + j, i, s) for c in range(1, cells + 1) for j in range(each)
             for i, s in ((0, 0.5 + (j * cells + c) / 4096), (c * size + (j + 1) % each, 0.3), (c * size + (j + 2) % each, 0.2))]
    edges = sorted([*edges, *((0, size + j, 0.1 + j / 1024) for j in range(3))])
    owner, ids, scores = (np.array(c, t) for c, t in zip(zip(*edges), (np.int64, np.int64, np.float32)))
    packs = nn_descent._packs(3, owner, ids, scores, np.ones(len(edges), bool))
    found = spark.createDataFrame([(int(r[0]), int(r[1]), *(a.tolist() for a in r[2:])) for r in packs.itertuples(index=False)], nn_descent._PACK)
    lists = nn_descent._merged(None, found)
    lists = lists.withColumn("fresh", F.when(F.col("cell") == 3, F.transform("fresh", lambda x: F.lit(False))).otherwise(F.col("fresh"))).localCheckpoint()
    every = sorted({int(i) for i in owner})
    x = np.random.default_rng(2).standard_normal((len(every), 8)).astype(np.float32)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in zip(every, x)], "node long, vec binary")

    sent, grouped = [], type(nodes.groupBy("node"))
    cogroup = grouped.cogroup
    monkeypatch.setattr(grouped, "cogroup", lambda self, other: sent.append(other._df) or cogroup(self, other))
    got = {(int(o), int(i)) for r in nn_descent._joined(lists, nodes).collect() for o, i in zip(r.owners, r.ids)}

    want, asked = set(), collections.defaultdict(set)
    for u in every:
        back = sorted((-s, o) for o, i, s in edges if i == u)[:nn_descent.REVERSE]
        members = {i for o, i, _ in edges if o == u} | {o for _, o in back}
        if u // size != 3:
            want |= set(itertools.permutations(members, 2))
            asked[u // size] |= members
    assert got == want
    assert {r.home: r["count"] for r in sent[0].groupBy("home").count().collect()} == {c: len(m) for c, m in asked.items()}
    assert len(asked[0]) <= nn_descent.DEGREE + nn_descent.REVERSE and 3 not in asked


def test_a_vector_goes_to_blocks_once_per_order(spark, monkeypatch):
    """The vectors that meet others while the index is built grow as the table does, not with its cells (2 and 4 here)."""
    monkeypatch.setattr(nn_descent, "ORDERS", 4, raising=False)
    sent, grouped = [], type(spark.range(1).groupBy("id"))
    apply, cogroup = grouped.applyInPandas, grouped.cogroup
    seen = lambda df: sent.append(df.count()) if "vec" in df.columns else None
    monkeypatch.setattr(grouped, "applyInPandas", lambda self, *a: seen(self._df) or apply(self, *a))
    monkeypatch.setattr(grouped, "cogroup", lambda self, other: seen(other._df) or cogroup(self, other))
    sums = []
    for n in (4_500, 13_500):
        rows = np.random.default_rng(n).standard_normal((n, 24)).tolist()
        index = nn_descent.build(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>"))
        lists = index.graph.collect()
        assert sorted(r.node for r in lists) == list(range(n)) and all(r.node not in r.ids for r in lists)
        sums.append(sum(sent))
        sent.clear()
    assert sums[1] == 3 * sums[0]
    assert sums[0] == 4 * 4_500


def test_blocks_hold_every_node_in_every_order(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "CELL", 40)
    monkeypatch.setattr(nn_descent, "ORDERS", 3)
    rows = [(i, [i % 2, i % 7, 0], bytearray(b"v")) for i in range(130)]       # one code for all in the last order
    placed = nn_descent._blocks(spark.createDataFrame(rows, "node long, codes array<long>, vec binary"), 130).collect()
    blocks = collections.defaultdict(list)
    for r in placed:
        blocks[r.block].append(r.node)
    assert sorted(blocks) == list(range(12)) and all(32 <= len(b) <= 33 for b in blocks.values())
    for turn in range(3):
        assert sorted(i for b in range(4 * turn, 4 * turn + 4) for i in blocks[b]) == list(range(130))


def test_descent_in_a_block(monkeypatch):
    x = np.random.default_rng(8).standard_normal((900, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    want = np.argsort(-near, axis=1)[:, :nn_descent.START]
    for most in (nn_descent.SORTED, 3_000):                    # pairs are cut to the best of them as they come, too
        monkeypatch.setattr(nn_descent, "SORTED", most)
        own, ids, score = nn_descent._descent(x, 1)
        assert (own == np.repeat(np.arange(900), nn_descent.START)).all() and len(set(zip(own, ids))) == len(own)
        assert (own != ids).all() and np.allclose(score, near[own, ids], atol=1e-5)
        hit = sum(len(np.intersect1d(a, b)) for a, b in zip(want, ids.reshape(900, -1)))
        assert hit >= 0.9 * want.size
    for n in (1, 2, 5):                                        # fewer than a list holds
        own, ids, _ = nn_descent._descent(x[:n], 1)
        assert sorted(zip(own.tolist(), ids.tolist())) == sorted(itertools.permutations(range(n), 2))


def test_rounds_over_the_whole_graph(spark, monkeypatch):
    for name, value in dict(CELL=64, ORDERS=2, DEGREE=24, REVERSE=12, LEAF=32, START=12, QUERY_BLOCK=16, ENTRIES=32, BEAM=64).items():
        monkeypatch.setattr(nn_descent, name, value)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(6).standard_normal((400, 10)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = _nearest(rows, lambda i: i % 20 == 0, 5)
    got = collections.defaultdict(set)
    for r in nn_descent.search(nn_descent.build(df, across=True), df.where("vec_id % 20 = 0"), 5).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len({i for _, i in want[q]} & got[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_top_k_extra_columns_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "QUERY_VALUES", 30)
    monkeypatch.setattr(vector_topk, "CANDIDATE_VALUES", 50)
    rows = [(i, [float(i % 7), float(-i % 5), 0.25 * i]) for i in range(120)] + [(50, [9e6, 0.0, 1.0]), (50, [9e6, 0.0, 1.0]), (7, [float("inf")]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("part", F.lit(3))
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if all(map(math.isfinite, v))]
    got = collections.defaultdict(list)
    for r in vector_topk.top_k(df.where("vec_id % 50 = 0"), df).collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    for q in (0, 100, 200):
        a = next(v for i, v in fine if i == q)
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:5]
        assert [(s, i) for _, s, i in sorted(got[q])] == best


# --- mixing ------------------------------------------------------------------------------------------------

def _plain_raking(cells, targets, budget):
    """Raking of {(source, lang, topic): tokens} in plain Python, capped at the cells' tokens."""
    total = sum(cells.values())
    kept = {c: n * budget / total for c, n in cells.items()}
    goals = []
    for d in range(3):
        n = collections.Counter()
        for c, v in cells.items():
            n[c[d]] += v
        t = targets[d](n)
        s = sum(t.values())
        lo, hi = 0.0, 1e6 * total
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(n[x], mid * t[x] / s) for x in n) < budget else (lo, mid)
        goals.append({x: min(n[x], lo * t[x] / s) for x in n})
    for _ in range(500):
        for d in range(3):
            have = collections.Counter()
            for c, v in kept.items():
                have[c[d]] += v
            kept = {c: min(cells[c], v * goals[d][c[d]] / have[c[d]]) for c, v in kept.items()}
    return kept


def test_mixing_equals_plain_raking(spark, monkeypatch):
    random.seed(6)
    cells = {(f"s{a}", lang, topic): random.randint(1, 400) * (9 if a == 0 else 1) for a in range(6) for lang in ("en", "de") for topic in ("x", "y", "z")
             if random.random() < 0.9}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "_source string, _lang string, _topic string, tokens long")
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6)
    monkeypatch.setattr(mixing, "STALLED", 1e-9)
    power = lambda a: lambda n: {x: v ** a for x, v in n.items()}
    want = _plain_raking(cells, [power(0.5), power(0.7), power(1.0)], 0.4 * sum(cells.values()))
    raked = mixing.fit(df, kept_share=0.4)
    for r in raked.collect():
        assert r.kept == pytest.approx(want[r._source, r._lang, r._topic], rel=1e-3)
    for r in mixing.marginals(raked).collect():
        assert r.reached <= r.target * 1.01 or r.dimension != "source" or r.tokens <= r.reached * 0.4 * sum(cells.values()) * 1.001


def test_mixing_has_no_cliff_and_says_what_it_misses(spark):
    def kept_with(words):
        rows = [("hot", "en", 30_000), *[(f"s{i}", "en", 5_000) for i in range(7)], ("rare", "de", words)]
        df = spark.createDataFrame([(s, lang, "x", n) for s, lang, n in rows], "_source string, _lang string, _topic string, tokens long")
        got = {r._source: r.kept for r in mixing.fit(df).collect()}
        return sum(got.values()) / sum(r[2] for r in rows), got["hot"] / 30_000

    sizes = [500, 600, 640, 660, 700, 900, 1500]      # 0.8% to 2.3% of all tokens
    seen = [kept_with(n) for n in sizes]
    for a, b in itertools.pairwise(seen):
        assert abs(a[0] - b[0]) < 0.01 and abs(a[1] - b[1]) < 0.01
    impossible = spark.createDataFrame([("a", "en", "x", 100), ("b", "de", "x", 100)], "_source string, _lang string, _topic string, tokens long")
    asked = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    with pytest.warns(UserWarning, match="marginals"):
        mixing.fit(impossible, asked)
    with pytest.raises(ValueError, match="marginals"):
        mixing.fit(impossible, asked, strict=True)


# --- class model --------------------------------------------------------------------------------------------

def test_class_model_finds_classes_and_both_lookups_agree(spark):
    random.seed(8)
    kinds = [[f"{k}{i}" for i in range(25)] for k in ("noun", "verb", "adj")]
    docs = [(i, " ".join(random.choice(kinds[j % 3]) for j in range(60))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    a, b = (sorted((r.doc_id, r.score, r.base_score) for r in class_lm.score_documents(df, limit=lim).collect()) for lim in (10**6, 5))
    assert a == b
    tokens = 61 * len(docs)
    # A word's class tells the next word's: two bits per word less than its frequency alone, nearly log2(3).
    assert (sum(s for _, s, _ in a) - sum(s for _, _, s in a)) / tokens > 0.9 * math.log10(3) * 60 / 61 - 0.05


def test_class_contexts_and_likelihood_equal_plain_counts(spark, monkeypatch):
    random.seed(2)
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 150)
    docs = [(i, " ".join(random.choices("abcdefgh", [9, 8, 7, 6, 5, 2, 1, 1], k=random.randint(0, 30)))) for i in range(60)]
    tables = []
    plain_table = class_lm._table
    monkeypatch.setattr(class_lm, "_table", lambda c: tables.append(plain_table(c)) or tables[-1])
    class_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), frequent_from=40).count()
    train = [t.split() for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    n = collections.Counter(w for t in train for w in [*t, ""])
    order = sorted(n, key=lambda w: (-n[w], w))
    number = {w: i for i, w in enumerate(order) if n[w] >= 40}        # at first every frequent word is a class of its own
    want = np.zeros((class_lm.CLASSES, class_lm.WIDE))
    for t in train:
        seq = ["", *t, ""]
        for v, w in zip(seq, seq[1:]):
            if w in number:
                want[number[w], number.get(v, class_lm.CLASSES)] += 1
        for w, x in zip([*t], [*t[1:], ""]):
            if w in number:
                want[number[w], class_lm.CLASSES + 1 + number.get(x, class_lm.CLASSES)] += 1
    assert (tables[0] == want).all()
    follow = want[:, class_lm.CLASSES + 1: -1]
    plain = sum(x * math.log(x) for x in follow.ravel() if x) - sum(x * math.log(x) for x in [*follow.sum(0), *follow.sum(1)] if x)
    assert class_lm.likelihood(want) == pytest.approx(plain)


# --- toxicity, identifiers, licences, pieces ------------------------------------------------------------------

def test_block_counts_do_not_depend_on_the_ids_that_wait(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 9))) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 300)
    want = collections.Counter()
    for doc_id, text in docs:
        if zlib.crc32(str(doc_id).encode()) % class_lm.FOLD:
            want.update([w.encode() for w in (text or "").split()] + [class_lm.END])
    for waiting in (1, 40, 10**6):
        monkeypatch.setattr(class_lm, "WAITING", waiting)
        rows = class_lm._blocks(df).where("kind = 0").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").collect()
        assert {bytes(r["word"]): r["n"] for r in rows} == want


def test_class_counts_of_many_words_hold_little(spark, monkeypatch):
    """Sorted counting: keys over several buffers equal plain counts, and long batches are unpacked in parts."""
    rng = np.random.default_rng(3)
    words, first, caught = 40_000, 1_000, []

    class Stub:
        def over(self, coded, work, schema):
            caught.append(work)
            return coded

    monkeypatch.setattr(class_lm, "DENSE", 0)
    monkeypatch.setattr(class_lm, "HELD", 1_500_000, raising=False)
    class_lm._contexts(spark.createDataFrame([], class_lm._COUNTS), Stub(), first, words, "<i4", 1)
    total = collections.Counter()
    monkeypatch.setattr(class_lm, "_emit", lambda first, flat, n: total.update(dict(zip((flat + first * class_lm.WIDE).tolist(), n.tolist()))) or len(flat))
    of = lambda ids: np.where(ids < 0, class_lm.CLASSES, ids % 7).astype(np.int32)
    texts = [np.append(rng.integers(-1, 50_000, 1_500), 0).astype("<i4") for _ in range(1_000)]
    batch = pd.DataFrame({"held_out": [i % 50 == 0 for i in range(1_000)], "n_tokens": [len(t) for t in texts],
                          "ids": [zlib.compress(t.tobytes(), 1) for t in texts]})
    sum(caught[0](iter([batch]), of))
    want = collections.Counter()
    for i, t in enumerate(texts):
        if i % 50:
            cls = of(t)
            for at, w in enumerate(t.tolist()):
                if first <= w < first + words:
                    want[w * class_lm.WIDE + int(cls[at - 1])] += 1
                    if at + 1 < len(t):
                        want[w * class_lm.WIDE + class_lm.CLASSES + 1 + int(cls[at + 1])] += 1
    assert total == want
    del want
    total.clear()
    monkeypatch.setattr(class_lm, "_emit", lambda first, flat, n: len(flat))
    tracemalloc.start()
    sum(caught[0](iter([batch]), of))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print("peak MB", peak)
    assert peak < 60


def test_toxicity_recall_and_plain_ftrl(spark):
    sf = "/root/testdata/check_s"      # the smallest table that fills the fit's bound of labelled rows
    rows = toxicity.op3_toxicity(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    print("recall", sum(r.predicted for r in toxic) / len(toxic), "of", len(toxic))
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) > 0
    random.seed(3)
    data = [(np.array(sorted(random.sample(range(16), 4))), random.randint(0, 1)) for _ in range(40)]
    w, b = toxicity.fit_shard(data, 4)
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / (
        (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    bias = lambda: -zb / ((toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA)
    for _ in range(toxicity.EPOCHS):
        for at, y in data:
            have, hb = {i: weight(i) for i in at}, bias()
            g = 1 / (1 + math.exp(-(sum(have.values()) + hb))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * have[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA * hb
            nb += g * g
    assert np.allclose(w, [weight(i) for i in range(16)]) and b == pytest.approx(bias())


def test_toxicity_repeated_rows_teach_once(spark):
    df = spark.createDataFrame([(i, f"word{i % 5} plain {'vilebad' * (i % 4 == 0)}", int(i % 4 == 0)) for i in range(200)], "doc_id long, text string, toxic int")
    once, many = toxicity.fit(df, df), toxicity.fit(df.union(df.where("doc_id = 1")).union(df.where("doc_id = 1")), df)
    assert (once[0] == many[0]).all() and np.allclose(once[1], many[1]) and once[2] == many[2]


def test_identifiers_behind_long_blanks_and_long_words(spark):
    long_word = "k" * 200
    rows = [(i, f"{long_word}{' ' * 80}user{i}@ex.com{' ' * 60}tail{'q' * 90}") for i in range(8)]
    rows += [(50 + i, f"{long_word}{' ' * 80}ab-{i}9999{' ' * 60}tail{'q' * 90}") for i in range(3)]
    near = pii.found_in(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.inline("near")).collect()
    assert {(r.l, r.r) for r in near} == {(long_word, "tail" + "q" * 90)}
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("<email>" in t for t in got.values())


def test_licences_need_their_version_and_survive_repeats(spark):
    a = licenses.Automaton()

    def labels(text):
        return sorted({s[0] for s in a.scan(text)["spans"] if s[3] >= licenses.MIN_COVER and s[4]})

    assert labels("All rights reserved") == [] and labels("This work is licensed under the GNU General Public License") == []
    assert labels("This work is licensed under the GNU General Public License, version 2") == ["gpl-2"]
    for label, text in licenses.TEMPLATES:
        assert label in labels(f"some words before {text} and after")
    mit = max((t for x, t in licenses.TEMPLATES if x == "mit"), key=len)
    words = licenses.plain_words(mit)
    broken = b" ".join(words[:60] + [b"inserted", b"words"] + words[60:]).decode()
    found = [s for s in a.scan(f"{broken} gap {'filler ' * 40} {mit}")["spans"] if s[0] == "mit" and s[3] > 0.95]
    assert len(found) >= 2
    # A template with a passage twice: the chain takes the place that fits.
    b = licenses.Automaton((("twice", "one two three four five six one two three four seven eight"),), ())
    (span,) = [s for s in b.scan("one two three four five six one two three four seven eight")["spans"]]
    assert span[1:4] == (0, 11, 1.0)


def test_decoded_documents_equal_the_library(spark, odd):  # noqa: F811
    import sentencepiece as spm

    path = sentencepiece_bpe.default_model()
    lib = spm.SentencePieceProcessor(model_file=path)
    encoded = sentencepiece_bpe.encode_documents(odd, path)
    got = sentencepiece_bpe.decode_documents(encoded, path).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, lib.decode(lib.encode(t or ""))) for i, t in ODD)
    assert sentencepiece_bpe.token_digests(odd.where("false"), path).count() == 0


# --- near duplicates and the pipeline ----------------------------------------------------------------------------

def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b = "p q r s t u", "v w x y z zz zzz"
    rows = [(5, a, 1, "k"), (5, b, 2, "k"), (7, a, 3, "k"), (7, "l1 l2 l3 l4 l5 l6 l7", 4, "z"), (8, b, 5, "k"), (8, b, 5, "k"), (None, a, 6, "n"),
            (9, "uniq one two three four five", 7, "q"), (9, "uniq one two three four five", 7, "q"), (10, None, 8, "x"), (10, "", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node int, _row string")
    assert sorted(r._node for r in jaccard_join.one_per_group(df).collect()) == [1, 2, 4, 6, 7, 8, 9]
    assert jaccard_join.one_per_group(df).columns == df.columns


def test_one_shingle_in_thousands_of_sets_gives_linear_pairs(spark, monkeypatch):
    """A passage that thousands of otherwise different texts share costs no pair per two texts."""
    checked = []
    plain = jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, sets, t: checked.append(pairs.count()) or plain(pairs, sets, t))
    rows = [(i, "this passage stands in every text " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(3000)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert got.where("doc_id <> component_id").count() == 0 and sum(checked) <= 3000


def _masked(text):
    """Base identifiers replaced by their kinds."""
    out, at = "", 0
    for span in filter(None, _python_spans(text).split(",")):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += text[at: int(start)] + f"<{kind}>"
        at = max(at, int(end))
    return out + text[at:]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece as spm

    random.seed(11)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "of", "and", "to", "in"] * 30
    rows = []
    for i in range(120):
        words = random.choices(vocabulary, k=random.randint(70, 160))
        lines = [" ".join(words[j: j + 12]) + "." for j in range(0, len(words), 12)]
        rows.append((i, "\n".join(lines) + (f" mail u{i}@ex{i}.org" if i % 9 == 0 else "")))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300 + i, rows[20 + i][1] + " added end") for i in range(5)]
    rows += [(400, "short"), (401, None), (402, "same words " * 80), (5, rows[60][1] + " its own text under a used number " + rows[61][1])]
    docs = [(i, t, ("en", "de")[i % 3 == 0], f"src{i % 4}" if i % 2 else "hot", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    con = duckdb.connect()
    con.execute(f"create view documents as select row_number() over () as doc_id, text, lang, source, n_chars from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    original = con.execute(f"select doc_id, text, lang, source from read_parquet('{tmp_path}/documents.parquet/*.parquet')").fetchall()
    verdict = {r[0]: r[1] for r in con.execute(f"select doc_id, kept from ({quality.ORACLE})").fetchall()}
    stay = [d for n, d in enumerate(original) if verdict[n + 1]]
    assert 0 < len(stay) < len(original)
    nodes = {n: d for n, d in enumerate(sorted(stay, key=lambda d: (d[0], d[1])))}
    groups = _groups([(n, d[1]) for n, d in nodes.items()], 5, 80)
    stay = [nodes[n] for n, (_, root) in groups.items() if root == n]
    stay = [(i, _masked(t), lang, source) for i, t, lang, source in stay]
    topic = {r.text: r.topic for r in spark.createDataFrame([(d[1],) for d in stay], "text string").select("text", mixing.topic_of(F.col("text")).alias("topic")).collect()}
    cells = collections.Counter()
    for _, t, lang, source in stay:
        cells[source, lang, topic[t]] += len(t.split())
    power = lambda a: lambda n: {x: v ** a for x, v in n.items()}
    kept = _plain_raking(dict(cells), [power(0.5), power(0.7), power(1.0)], mixing.KEPT_SHARE * sum(cells.values()))
    turn = {(r.doc_id, r.text): r.turn for r in spark.createDataFrame([(d[0], d[1]) for d in stay], "doc_id long, text string").select(
        "doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("turn")).collect()}
    lib = spm.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    sure, maybe = [], 0
    for i, t, lang, source in stay:
        p = kept[source, lang, topic[t]] / cells[source, lang, topic[t]]
        if abs(turn[i, t] - p) < 0.005:       # the raking's tolerance decides
            maybe += 1
        elif turn[i, t] < p:
            sure.append((i, tuple(lib.encode(t)), lib.decode(lib.encode(t))))
    have = collections.Counter((r.doc_id, tuple(r.ids), r.text) for r in got)
    assert not collections.Counter(sure) - have and sum(have.values()) <= len(sure) + maybe and maybe < 5


def test_new_operators_on_odd_rows_and_empty_tables(spark, odd):  # noqa: F811
    empty = odd.where("false")
    assert collocations.collocations(empty).count() == 0 and resampling.resample(empty, odd).count() == 0
    got = collocations.collocations(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang for r in got} == {"und"} and {r.phrase for r in got} <= {"x x", "x x x", "x x x x", "same text", "text same", "same text same",
                                                                          "text same text", "same text same text", "text same text same"}
    assert resampling.resample(odd, odd).count() == len(ODD)


def test_neighbours_that_share_no_block_are_found(spark, monkeypatch):
    """The operator's graph holds nodes that lie in one block in no order (3 blocks in each of 2 orders here)."""
    monkeypatch.setattr(nn_descent, "ORDERS", 2)
    monkeypatch.setattr(nn_descent, "search", lambda index, queries, k: index)
    rows = np.random.default_rng(12).standard_normal((9_000, 16)).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    index = nn_descent.nearest(df, df)
    nodes = sorted((r.node, bytes(r.vec)) for r in index.nodes.collect())
    x = np.frombuffer(b"".join(v for _, v in nodes), np.float32).reshape(len(nodes), -1)
    lists = {r.node: set(r.ids) for r in index.graph.collect()}
    hit = 0
    for node in range(0, 9_000, 30):
        near = x @ x[node]
        near[node] = -np.inf
        hit += len(lists[node] & set(np.argpartition(-near, 20)[:20].tolist()))
    print("recall", hit / 6_000)
    assert hit >= 0.9 * 6_000
