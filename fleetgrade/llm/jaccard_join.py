"""N-gram Jaccard join: size-aware heavy-light set join (operator 9).

A document's set holds the 64-bit hashes of its distinct word k-shingles. Documents link
when ``den * |intersection| >= num * |union|`` (for whole numbers num/den). Equal sets are
one node (grouped by a 128-bit digest), so copies cost one row each and no pairs.

Light sets (up to a size chosen by cost from the histogram of sizes) list all their
subsets of each size a partner could need. Among the sets that share such a subset, the
smallest one links with every set that links with anyone there, so one edge to it per
member gives the exact components and pairs within a group are never listed.

Heavy sets go through inverted lists. A first pass keeps only documents with enough of
their ``m`` least-hash shingles in other documents' lists (a linked pair must share at least
``c`` of them). Among those, exact document frequencies give the rare-first order; a
document enters the lists of its first ``d + 1`` shingles (``d``: the most shingles a linked
partner may lack), and those that no other document has use up that number. Lists are
scanned in rounds: every member is compared with one pivot of the list, links are
contracted to components, and members already in the pivot's component are not compared
again. The last round compares what is left: members of different components of a list,
by size and position bounds. Pairs are checked by exact intersection. Sets near the
boundary take both ways, so light-heavy links are found as well.

Edge cases: a text with fewer than k words is one shingle; null texts, texts without words
and rows without doc_id link with nothing (component: own doc_id); several rows with one
doc_id are one node whose texts all count; repeated rows give repeated result rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.numbering import numbered
from fleetgrade.llm.common import word_bytes
from fleetgrade.llm.components import components
from fleetgrade.session import cut_lineage

BROADCAST_IDS = 1_000_000   # candidate ids (8 bytes each) that may be broadcast; more are joined by shuffle
LIGHT_LIMIT = 48            # sizes considered for the light side
ROUNDS = 3

_MEMO: dict[bytes, int] = {}


def shingles(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the word k-shingles."""
    import numpy as np
    import xxhash

    ws = word_bytes(text)
    if not ws:
        return np.empty(0, np.int64)
    memo, digest = _MEMO, xxhash.xxh3_64_intdigest
    if len(memo) > 120_000:   # words with their hashes: about 20 MB a worker
        memo.clear()
    h = np.fromiter((memo.get(w) or memo.setdefault(w, digest(w) | 1) for w in ws), dtype=np.uint64, count=len(ws))
    size = min(k, len(ws))
    n = len(ws) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i: i + n]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


class Threshold:
    """Whole-number bounds of ``den * inter >= num * union``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, n: int) -> int:
        """Smallest partner size."""
        return -(-self.num * n // self.den)

    def lack(self, n: int) -> int:
        """Most elements that a partner may lack."""
        return n - self.least(n)

    def spare(self, n: int) -> int:
        return max(1, (self.den - self.num) * n // (2 * self.den))

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({o for b in range(self.least(n), self.den * n // self.num + 1)
                       if (o := self.overlap(n, b)) <= min(n, b)})

    def light_rows(self, n: int) -> int:
        return sum(comb(n, o) for o in self.subset_sizes(n))

    def heavy_rows(self, n: int) -> int:
        return 2 * (self.lack(n) + self.spare(n)) + 2 * n

    def boundary(self, histogram: dict[int, int]) -> int:
        """Largest light size with the least expected rows in total."""
        best, at, light = None, 0, 0
        total = sum(c * self.heavy_rows(n) for n, c in histogram.items())
        for x in range(0, LIGHT_LIMIT + 1):
            c = histogram.get(x, 0)
            light += c * (self.light_rows(x) - self.heavy_rows(x)) if x else 0
            if best is None or total + light <= best:
                best, at = total + light, x
            if x and self.light_rows(x) > 5_000:
                break
        return at


def document_sets(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """``doc_id, n, sig, head`` (least hashes: all of a small set, else ``lack + spare``)."""
    import numpy as np
    import pandas as pd
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, sig, head = [], [], []
            for text in b["text"]:
                s = shingles(text, k)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                head.append(s if len(s) <= LIGHT_LIMIT else s[: t.lack(len(s)) + t.spare(len(s))])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": np.array(n, np.int64), "sig": sig, "head": head})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, sig binary, head array<long>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "toks": [shingles(x, k) for x in b["text"]]})

    return docs.select("doc", "text").mapInPandas(run, "doc long, toks array<long>")


def light_edges(reps: DataFrame, t: Threshold, top: int) -> DataFrame:
    """One edge per light set and shared subset, to the subset's smallest owner."""
    import pandas as pd
    from itertools import combinations

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, n, head in zip(b["rep"], b["n"], b["head"], strict=True):
                s = [int(x) for x in head]
                whole = sum(s)
                keys, sizes = [], []
                for o in t.subset_sizes(n):
                    for gone in combinations(s, n - o):
                        keys.append((whole - sum(gone) + o * 0x2545F4914F6CDD1D + (1 << 63)) % (1 << 64) - (1 << 63))
                        sizes.append(o)
                yield pd.DataFrame({"key": keys, "o": sizes, "doc": doc, "n": n})

    rows = reps.where((F.col("n") > 0) & (F.col("n") <= top)).select("rep", "n", "head").mapInPandas(
        run, "key long, o long, doc long, n long")
    first = rows.groupBy("key", "o").agg(F.min(F.struct("n", "doc")).alias("p"), F.count("*").alias("c")).where("c > 1")
    limit = F.floor(F.col("o") * (t.num + t.den) / t.num)  # sets that share o link up to this sum of sizes
    return (rows.join(first.drop("c"), ["key", "o"])
            .where((F.col("n") + F.col("p.n") <= limit) & (F.col("doc") != F.col("p.doc")))
            .select(F.col("doc").alias("u"), F.col("p.doc").alias("v")).distinct())


def _need(t: Threshold, a: Column, b: Column) -> Column:
    return F.ceil((a + b) * t.num / F.lit(t.num + t.den) - F.lit(1e-9))


def _possible(t: Threshold, n1, p1, n2, p2) -> Column:
    """Size and position bounds of two members of a list."""
    n1, p1, n2, p2 = map(F.col, (n1, p1, n2, p2))
    return ((F.least(n1, n2) * t.den >= F.greatest(n1, n2) * t.num)
            & (F.least(n1 - p1, n2 - p2) >= _need(t, n1, n2)))


def verify(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs ``u, v`` that link, by exact intersection."""
    ids = pairs.select(F.col("u").alias("doc")).union(pairs.select(F.col("v").alias("doc"))).distinct()
    few = cut_lineage(sets.join(ids, "doc", "left_semi"), "sets-few")
    both = pairs.join(few.select(F.col("doc").alias("u"), F.col("toks").alias("a")), "u").join(
        few.select(F.col("doc").alias("v"), F.col("toks").alias("b")), "v")
    inter = F.size(F.array_intersect("a", "b"))
    return (both.select("u", "v", (F.size("a") + F.size("b")).alias("s"), inter.alias("i"))
            .where(F.col("i") * (t.den + t.num) >= F.col("s") * t.num).select("u", "v"))


def heavy_edges(reps: DataFrame, docs: DataFrame, k: int, t: Threshold, light: int, known: DataFrame) -> DataFrame:
    """Edges of the sets above ``light`` (and those near it) that join all linked sets."""
    low = t.least(light + 1)
    big = reps.where(F.col("n") >= max(1, low))
    # 1. Documents with enough of their least shingles in other documents' heads.
    n = F.col("n")
    lack = n - F.ceil(n * t.num / F.lit(t.den) - F.lit(1e-9))
    spare = lambda x: F.greatest(F.lit(1), F.floor(x * (t.den - t.num) / F.lit(2 * t.den) + F.lit(1e-9)))
    heads = big.select("rep", "n", F.explode(F.slice("head", 1, (lack + spare(n)).cast("int"))).alias("tok"))
    shared = heads.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    some = spare(F.ceil(n * t.num / F.lit(t.den) - F.lit(1e-9)))
    held = cut_lineage(heads.join(shared, "tok", "left_semi").groupBy("rep", "n").agg(F.count("*").alias("c"))
                       .where(F.col("c") >= some).select(F.col("rep").alias("doc"), "n"), "held")
    # 2. Their whole sets, and the rare-first order.
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    ids = held.select("doc")
    ids = F.broadcast(ids) if held.count() <= BROADCAST_IDS else ids
    sets = cut_lineage(whole_sets(texts.join(ids, "doc", "left_semi"), k), "sets")
    toks = sets.select("doc", F.explode("toks").alias("tok"))
    df = toks.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (toks.join(df, "tok").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("s"))
              .join(held, "doc"))
    alone = n - F.size("s")
    take = F.greatest(F.lit(0), (lack + 1 - alone)).cast("int")
    lists = cut_lineage(ranked.select("doc", "n", alone.alias("alone"), F.posexplode(F.slice("s", 1, take)).alias("j", "e"))
                        .select(F.col("e.tok").alias("tok"), "doc", "n", (F.col("alone") + F.col("j")).alias("pos")), "lists")
    # 3. Rounds of one pivot per list, then the rest.
    edges = known
    for r in range(ROUNDS):
        comp = components(edges)
        now = _labelled(lists, comp)
        by = F.struct("pos", "n", "doc", "comp") if r == 0 else F.struct(F.xxhash64("doc", F.lit(r)).alias("h"), "pos", "n", "doc", "comp")
        heads = (now.groupBy("tok").agg(F.min(by).alias("p"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
                 .where("c1 <> c2"))
        near = now.join(heads, "tok").select("doc", "n", "pos", "comp", F.col("p.doc").alias("pd"), F.col("p.n").alias("pn"),
                                             F.col("p.pos").alias("pp"), F.col("p.comp").alias("pc")).where("comp <> pc")
        near = near.where(_possible(t, "n", "pos", "pn", "pp"))
        if r == 0:  # the pivot that shares most lists
            near = (near.groupBy("doc", "pd").agg(F.count("*").alias("c")).groupBy("doc")
                    .agg(F.max_by("pd", F.struct("c", -F.col("pd"))).alias("pd")))
        pairs = cut_lineage(near.select(F.least("doc", "pd").alias("u"), F.greatest("doc", "pd").alias("v")).distinct(), "pairs")
        edges = edges.union(verify(pairs, sets, t))
        edges = cut_lineage(edges, "links")
    now = _labelled(lists, components(edges))
    mixed = now.groupBy("tok").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("tok")
    rest = cut_lineage(now.join(mixed, "tok", "left_semi"), "rest")
    other = rest.select("tok", *(F.col(c).alias(f"{c}2") for c in ("doc", "n", "pos", "comp")))
    pairs = (rest.join(other, "tok").where("doc < doc2 and comp <> comp2").where(_possible(t, "n", "pos", "n2", "pos2"))
             .select(F.col("doc").alias("u"), F.col("doc2").alias("v")).distinct())
    return edges.union(verify(cut_lineage(pairs, "pairs"), sets, t))


def _labelled(lists: DataFrame, comp: DataFrame) -> DataFrame:
    return lists.join(comp, F.col("doc") == F.col("node"), "left").select(
        "tok", "doc", "n", "pos", F.coalesce("component", "doc").alias("comp"))


def jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    t = Threshold(num, den)
    rows = cut_lineage(document_sets(docs, k, t), "heads")
    # Equal sets are one node, named by the least doc_id.
    nodes = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = cut_lineage(nodes.groupBy("n", "sig").agg(F.min(F.struct("doc_id", "head")).alias("r"))
                       .select(F.col("r.doc_id").alias("rep"), "n", "sig", F.col("r.head").alias("head")), "reps")
    sizes = {r["n"]: r["c"] for r in reps.groupBy(F.least("n", F.lit(LIGHT_LIMIT + 1)).alias("n"))
             .agg(F.count("*").alias("c")).collect()}
    light = t.boundary(sizes)
    edges = cut_lineage(light_edges(reps, t, light), "links")
    edges = heavy_edges(reps, docs, k, t, light, edges)
    same = nodes.join(reps.select("n", "sig", "rep"), ["n", "sig"]).where("doc_id <> rep").select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comp = components(edges.union(same))
    return rows.select("doc_id", "n").join(comp, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of linked texts, the one with the least doc_id.

    A row is a node of its own by doc_id and text: rows that share an id but not the text stand
    for themselves, and of rows equal in both one stays. Rows without doc_id stay.
    """
    own = F.xxhash64("text").alias("_h")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), own)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), own).distinct()
    if texts.groupBy("_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("_node", F.col("_id"))
    else:  # nodes get numbers in the order of the ids, so the least one still stays
        numbers = numbered(texts, ["_id", "_h"], "_node")
        rows = cut_lineage(rows.join(numbers, ["_id", "_h"], "left"), "keyed-rows")
    nodes = rows.select(F.col("_node").alias("doc_id"), F.col("_row.text").alias("text"))
    comp = cut_lineage(jaccard_components(nodes, k, num, den), "groups")
    gone = comp.where("doc_id <> component_id").select(F.col("doc_id").alias("_node")).distinct()
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "_node", "left_anti")
    twice = comp.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_node"))
    if not twice.isEmpty():
        again = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
        out = out.join(again, "_node", "left_anti").select("_row").unionByName(
            out.join(again, "_node", "left_semi").groupBy("_node").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)
