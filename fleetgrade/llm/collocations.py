"""Phrase collocation mining with HAT-trie counting (operator 11).

Words are counted per language first; a word seen fewer than ``LEAST`` times is in no
candidate and ends a window, as the end of a piece does. Frequent words get dense numbers.

Counting. Texts are cut into blocks of at most ``BLOCK_TOKENS`` tokens of one language where
they are read; a block's distinct words meet their numbers by a join and come back to the
block. There every window of up to four words goes into a HAT-trie: a shallow trie over word
numbers whose leaves are hash containers; a container of more than ``BURST`` strings bursts
into one container per next word, and whole subtrees are spilled as sorted runs when the trie
holds more than ``HELD`` strings, the largest ones first. One insertion per position is
enough, because a shorter phrase's count is the sum over its subtree.

Runs are cut at prefixes: one word; where it occurs more than ``SPLIT`` times in the corpus,
as many parts of its continuations as its count has multiples of ``SPLIT``; where the second
word is as frequent, too, parts of the pair's continuations (such pairs send their own sums).
So all runs of a prefix or part meet in one place, a place holds about ``SPLIT`` strings, and a
frequent word or pair spreads over many. Sorted runs are merged in partitions by prefix;
strings with fewer than ``LEAST`` occurrences go.

Scores. Parts of candidates are candidates or single words themselves, so both counts of a
cut come by equi-joins on word numbers; the containment rule is one aggregate of the longest
candidates' parts. Numbers are whole throughout (decimals where products may pass 64 bits).
Per language, only rows that can be in the first ``TOP`` get their words back and are ranked.

Edge cases: null and empty texts have no words; a null lang counts as ``und``; equal rows
count each; a word is any bytes between separators, however long; ties end with the phrase's
bytes, which are distinct; one text may fill many blocks (a block that ends inside a text holds
its next three words as well, so that its last windows are whole); extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgrade.functions.numbering import numbered
from fleetgrade.session import cut_lineage

LEAST, TOP, WORDS = 30, 2_000, 4
CONTAINED, OF = 80, 100
BLOCK_TOKENS = 2_000_000
BURST, HELD, SPLIT = 50_000, 1_000_000, 1_000_000
_BITS = 21                      # a block has fewer than 2^21 distinct words
_LOW = (1 << _BITS) - 1
_BREAK = b"."                   # a separator byte, thus no part of a word
_TABLE = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")
_RAW = "kind int, block long, lang string, idx long, word binary, n long, toks binary"
_RUN = "lang string, p1 long, p2 long, p3 long, run binary"
_PHRASE = "lang string, w1 long, w2 long, w3 long, w4 long, size int, a long"


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, and ``_BREAK`` between pieces."""
    return text.encode().lower().translate(_TABLE).replace(b".", b" . ").split() if text else []


class HatTrie:
    """Counts of windows ``(first word, packed rest)`` in burstable hash containers."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root = burst, {}

    def add(self, first: list[int], rest: list[int]) -> None:
        root = self.root
        for a, s in zip(first, rest, strict=True):
            c = root.get(a)
            if c is None:
                c = root[a] = {}
            elif type(c) is list:      # burst: containers by the second word
                c = c[0].setdefault(s >> 2 * _BITS, {})
            c[s] = c.get(s, 0) + 1

    def containers(self, a: int):
        c = self.root[a]
        return c[0].values() if type(c) is list else (c,)

    def tidy(self) -> dict[int, int]:
        """Burst large containers; the sizes of the root's subtrees."""
        for a, c in self.root.items():
            if type(c) is dict and len(c) > self.burst:
                below = {}
                for s, n in c.items():
                    below.setdefault(s >> 2 * _BITS, {})[s] = n
                self.root[a] = [below]
        return {a: sum(map(len, self.containers(a))) for a in self.root}

    def spill(self, subtrees):
        """Take whole subtrees out as one sorted run: first words, packed rests, counts."""
        from itertools import chain

        import numpy as np

        subtrees = list(subtrees)
        size = [sum(map(len, self.containers(a))) for a in subtrees]
        held = [c for a in subtrees for c in self.containers(a)]
        rest = np.fromiter(chain.from_iterable(held), np.int64, sum(size))
        count = np.fromiter(chain.from_iterable(c.values() for c in held), np.int64, sum(size))
        first = np.repeat(np.array(subtrees, np.int64), size)
        for a in subtrees:
            del self.root[a]
        order = np.lexsort((rest, first))
        return first[order], rest[order], count[order]


def windows(ranks, starts: int):
    """First words and packed rests of the windows of two to four known words that begin in the
    first ``starts`` places (0 ends a window)."""
    import numpy as np

    r = np.concatenate([ranks, np.zeros(WORDS - 1, np.int64)])
    n = len(ranks)
    a, b, c, d = (r[i: n + i] for i in range(WORDS))
    c = np.where(b > 0, c, 0)
    d = np.where(c > 0, d, 0)
    fine = (a > 0) & (b > 0) & (np.arange(n) < starts)
    return a[fine], (b[fine] << 2 * _BITS) | (c[fine] << _BITS) | d[fine]


def _dealt(numbers, parts):
    """A part ``1 .. parts`` for each word number, the same in every block."""
    import numpy as np

    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % parts.astype(np.uint64)).astype(np.int64) + 1


def prefix_rows(first, rest, count, numbers, freq, split, width):
    """A sorted run cut at its prefixes: ``p1, p2, p3, run`` columns.

    ``p2`` is 0 for a whole first word, a negative part of its continuations where it is frequent,
    or the second word's number where that is frequent as well; ``p3`` is then a part of the pair's
    continuations, 0 for the pair itself.
    """
    import numpy as np

    a, b, c, d = first, rest >> 2 * _BITS, (rest >> _BITS) & _LOW, rest & _LOW
    fa, fb = freq[a], freq[b]
    both = (fa > split) & (fb > split)
    parts = -(-np.minimum(fa, fb) // split)
    p2 = np.where(fa > split, np.where(both, numbers[b], -_dealt(numbers[b], -(-fa // split))), 0)
    p3 = np.where(both & (parts > 1) & (c > 0), _dealt(numbers[c], np.maximum(parts, 1)), 0)
    deep = np.flatnonzero(p3 > 0)
    if len(deep):  # pairs whose strings are spread by their third word
        da, db = a[deep], b[deep]
        at = np.flatnonzero(np.concatenate([[True], (da[1:] != da[:-1]) | (db[1:] != db[:-1])]))
        zero = np.zeros(len(at), np.int64)
        a, b, c, d, p2, p3, count = (np.concatenate(p) for p in (
            (a, da[at]), (b, db[at]), (c, zero), (d, zero), (p2, numbers[db[at]]), (p3, zero), (count, np.add.reduceat(count[deep], at))))
    if p2.any():
        order = np.lexsort((d, c, b, p3, p2, a))
        a, b, c, d, p2, p3, count = (x[order] for x in (a, b, c, d, p2, p3, count))
    raw = np.stack([numbers[b], numbers[c], numbers[d], count], axis=1).astype(width).tobytes()
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p2[1:] != p2[:-1]) | (p3[1:] != p3[:-1])]) if len(a) else np.empty(0, bool)
    at = np.flatnonzero(new)
    ends = (np.append(at, len(a)) * 4 * np.dtype(width).itemsize).tolist()
    return {"p1": numbers[a[at]], "p2": p2[at], "p3": p3[at], "run": [raw[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]}


def summed(group, b, c, d, count):
    """Sorted strings of each group, equal ones summed."""
    import numpy as np

    order = np.lexsort((d, c, b, group))
    group, b, c, d, count = (x[order] for x in (group, b, c, d, count))
    at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]))
    return group[at], b[at], c[at], d[at], np.add.reduceat(count, at)


def _blocks(docs: DataFrame) -> DataFrame:
    """Kind 0: a block's words with their counts; kind 1: its tokens as word numbers, 0 between pieces."""
    import zlib

    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    columns = ["kind", "block", "lang", "idx", "word", "n", "toks"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"block": TaskContext.get().partitionId() * 10_000_000}
        index, stream, count = {}, {}, 0        # per language; together at most BLOCK_TOKENS tokens

        def flush(lang, ahead=()):
            """The language's block; ``ahead`` are the next words of a text that goes on in the next block."""
            words, block = index.pop(lang), state["block"]
            state["block"] += 1
            ids = np.concatenate(stream.pop(lang))
            n = np.bincount(ids, minlength=len(words) + 1)
            ahead = [0 if w == _BREAK else words.get(w) or words.setdefault(w, len(words) + 1) for w in ahead]
            n = np.pad(n, (0, len(words) + 1 - len(n)))
            names = list(words)
            for lo in range(0, len(names), 20_000):
                part = names[lo: lo + 20_000]
                yield pd.DataFrame({"kind": 0, "block": block, "lang": lang, "idx": range(lo + 1, lo + 1 + len(part)), "word": part,
                                    "n": n[lo + 1: lo + 1 + len(part)], "toks": None}, columns=columns)
            packed = np.concatenate([[len(ahead)], ids, ahead]).astype(np.int32).tobytes()
            yield pd.DataFrame({"kind": [1], "block": [block], "lang": [lang], "idx": [0], "word": [None], "n": [0],
                                "toks": [zlib.compress(packed, 1)]}, columns=columns)

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = tokens(text)
                at = 0
                while at < len(words):
                    part = words[at: at + BLOCK_TOKENS - count]
                    own = index.setdefault(lang, {})
                    # One dictionary step per token; a break is number 0.
                    ids = np.fromiter((0 if w == _BREAK else own.get(w) or own.setdefault(w, len(own) + 1) for w in part),
                                      np.int32, len(part))
                    stream.setdefault(lang, []).append(ids)
                    at, count = at + len(part), count + len(part)
                    if at == len(words):
                        stream[lang].append(np.zeros(1, np.int32))
                    if count >= BLOCK_TOKENS:
                        for name in list(index):
                            yield from flush(name, words[at: at + WORDS - 1] if name == lang else ())
                        count = 0
        for name in list(index):
            yield from flush(name)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
                       ).mapInPandas(run, _RAW)


def _runs(blocks: DataFrame, numbers: DataFrame, width: str) -> DataFrame:
    """Sorted runs of all blocks' HAT-tries."""
    import zlib

    import numpy as np
    import pandas as pd

    def in_block(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["lang", "p1", "p2", "p3", "run"])]
        lang, words = texts["lang"].iloc[0], words.sort_values("id")
        raw = np.frombuffer(zlib.decompress(texts["toks"].iloc[0]), np.int32)
        own, ids = len(raw) - 1 - int(raw[0]), raw[1:]
        rank = np.zeros(int(max(ids.max(initial=0), words["idx"].max() if len(words) else 0)) + 1, np.int64)
        rank[words["idx"].to_numpy(np.int64)] = np.arange(1, len(words) + 1)
        number = np.concatenate([[0], words["id"].to_numpy(np.int64)])
        freq = np.concatenate([[0], words["f"].to_numpy(np.int64)])
        ranks = rank[ids]
        trie = HatTrie(BURST)

        def rows(first, rest, count):
            return pd.DataFrame({"lang": lang} | prefix_rows(first, rest, count, number, freq, SPLIT, width), columns=["lang", "p1", "p2", "p3", "run"])

        step = 200_000
        for at in range(0, own, step):
            first, rest = windows(ranks[at: at + step + WORDS - 1], min(step, own - at))
            trie.add(first.tolist(), rest.tolist())
            size = trie.tidy()
            total = sum(size.values())
            if total > HELD:
                gone = []
                for a in sorted(size, key=size.get, reverse=True):
                    gone.append(a)
                    total -= size[a]
                    if total <= HELD // 2:
                        break
                out.append(rows(*trie.spill(gone)))
        if trie.root:
            out.append(rows(*trie.spill(trie.root)))
        return pd.concat(out[1:] or out)

    texts = blocks.where("kind = 1").select(F.col("block").alias("own"), "lang", "toks")
    coded = blocks.where("kind = 0").join(numbers, ["lang", "word"]).select("block", "idx", "id", "f")
    return texts.groupBy("own").cogroup(coded.groupBy("block")).applyInPandas(in_block, _RUN)


def _merged(runs: DataFrame, least: int, width: str) -> DataFrame:
    """Phrases of two to four words with at least ``least`` occurrences, from runs merged by prefix."""
    import numpy as np
    import pandas as pd

    def phrases(rows: pd.DataFrame):
        """Of whole groups: the phrases of every length, by sums over their subtrees."""
        key = rows[["lang", "p1", "p2", "p3"]]
        new = (key != key.shift()).any(axis=1).to_numpy()
        heads = key[new].reset_index(drop=True)
        flat = np.frombuffer(b"".join(rows["run"]), width).reshape(-1, 4).astype(np.int64)
        size = rows["run"].map(len).to_numpy() // (4 * np.dtype(width).itemsize)
        g, b, c, d, n = summed(np.repeat(np.cumsum(new) - 1, size), *flat.T)
        whole = heads["p3"].to_numpy(np.int64)[g] == 0
        for words, fine in ((4, d > 0), (3, c > 0), (2, whole)):
            cols = [x[fine] for x in (g, b, c, d)[:words]]
            if not len(cols[0]):
                continue
            change = np.zeros(len(cols[0]), bool)
            change[0] = True
            for x in cols:
                change[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(change)
            total = np.add.reduceat(n[fine], at)
            at, total = at[total >= least], total[total >= least]
            own = cols[0][at]
            tail = [x[at] for x in cols[1:]] + [np.zeros(len(at), np.int64)] * (4 - words)
            yield pd.DataFrame({"lang": heads["lang"].to_numpy()[own], "w1": heads["p1"].to_numpy()[own], "w2": tail[0], "w3": tail[1],
                                "w4": tail[2], "size": np.full(len(at), words, np.int32), "a": total})

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        """One group's rows as one."""
        flat = np.frombuffer(b"".join(rows["run"]), width).reshape(-1, 4).astype(np.int64)
        _, b, c, d, n = summed(np.zeros(len(flat), np.int64), *flat.T)
        one = rows.iloc[:1].copy()
        one["run"] = [np.stack([b, c, d, n], axis=1).astype(width).tobytes()]
        return one

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = rows[["lang", "p1", "p2", "p3"]]
            last = int(np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())[-1])
            if last:
                yield from phrases(rows.iloc[:last])
            held = rows.iloc[last:]
            if len(held) > 64:
                held = reduce(held)
        if held is not None:
            yield from phrases(held)

    return (runs.repartition("lang", "p1", "p2", "p3").sortWithinPartitions("lang", "p1", "p2", "p3").mapInPandas(run, _PHRASE))


def count_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``phrases`` (two to four word numbers, a), frequent ``words`` (lang, word, f, id) and ``totals`` (lang, n)."""
    blocks = cut_lineage(_blocks(docs), "colloc-blocks", ["kind"])
    every = cut_lineage(blocks.where("kind = 0").groupBy("lang", "word").agg(F.sum("n").alias("f")), "colloc-words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = cut_lineage(numbered(every.where(F.col("f") >= least), ["lang", "word"], "id").withColumn("id", F.col("id") + 1), "colloc-numbers")
    # Counts that do not fit in 32 bits need the wide form as well, so it follows the corpus' size.
    tokens_all = totals.agg(F.sum("n")).first()[0] or 0
    width = "<u4" if tokens_all < 1 << 32 else "<i8"
    phrases = cut_lineage(_merged(_runs(blocks, words, width), least, width), "colloc-phrases")
    return phrases, words, totals


def _parts(size: int) -> list[tuple[int, int]]:
    """Contiguous parts (first, words) of two words or more that are shorter than ``size``."""
    return [(i, n) for n in range(2, size) for i in range(size - n + 1)]


def _key(first: int, words: int) -> list:
    """Three word numbers of a part, 0 behind its end."""
    return [F.col(f"w{first + j + 1}") if j < words else F.lit(0).cast("long") for j in range(3)]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    phrases, words, totals = count_phrases(docs, least)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    zero = F.lit(0).cast("long")
    counts = phrases.where("size <= 3").select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("w3").alias("z"), F.col("a").alias("f")).unionByName(
        words.select(F.col("id").alias("x"), zero.alias("y"), zero.alias("z"), "f"))
    cut = [F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), *(c.alias(f"l{i}") for i, c in enumerate(_key(0, k))),
                    *(c.alias(f"r{i}") for i, c in enumerate(_key(k, m - k)))) for m in (2, 3, 4) for k in range(1, m)]
    cuts = phrases.withColumn("cut", F.explode(F.filter(F.array(*cut), lambda c: c["m"] == F.col("size"))))
    for side, name in (("l", "l"), ("r", "r")):
        part = counts.select("x", "y", "z", F.col("f").alias(name))
        cuts = cuts.join(part, [F.col(f"cut.{side}{i}") == F.col(c) for i, c in enumerate("xyz")]).drop("x", "y", "z")
    cuts = cuts.withColumn("score", F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)"))
    whole = ["lang", "w1", "w2", "w3", "w4", "size", "a"]
    scored = cuts.groupBy(*whole).agg(F.min(F.struct("score", F.col("cut.k").alias("k"), "l", "r")).alias("s"))
    # The most frequent longer candidate around each phrase.
    part = [F.struct(F.lit(m).alias("m"), *(c.alias(f"v{i}") for i, c in enumerate(_key(first, n), 1))) for m in (3, 4) for first, n in _parts(m)]
    around = (phrases.where("size >= 3").select("lang", "a", F.explode(F.filter(F.array(*part), lambda p: p["m"] == F.col("size"))).alias("p"))
              .groupBy("lang", "p.v1", "p.v2", "p.v3").agg(F.max("a").alias("most")))
    same = [scored["lang"] == around["lang"], F.col("w1") == F.col("v1"), F.col("w2") == F.col("v2"), F.col("w3") == F.col("v3"), F.col("w4") == 0]
    left = (scored.join(around, same, "left").where(F.col("most").isNull() | (big("most") * OF < big("a") * CONTAINED))
            .select(scored["lang"], *whole[1:], "s.*"))
    # Rows that can be among the first, ties included, get their words back.
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = cut_lineage(left.withColumn("place", F.rank().over(by)).where(F.col("place") <= top), "colloc-best")
    spelled = (best.select("w1", "w2", "w3", "w4", F.posexplode(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w > 0)).alias("at", "id"))
               .join(words.select("id", "word"), "id").groupBy("w1", "w2", "w3", "w4")
               .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda p: p["word"].cast("string")).alias("ws")))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.join(spelled, ["w1", "w2", "w3", "w4"]).withColumn("phrase", F.concat_ws(" ", "ws"))
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with texts as (
  select row_number() over () as row, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
words as (select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda w: w <> '') as w from pieces),
grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) as g
  from words, range(1, 5) s(m) where len(w) >= m),
f as materialized (select lang, m, g, array_to_string(g, ' ') as p, count(*) as a from grams group by lang, m, g),
n as (select lang, sum(a)::bigint as n from f where m = 1 group by lang),
candidate as materialized (select * from f where m >= 2 and a >= 30),
cut as materialized (
  select lang, g, a, k, array_to_string(g[1:k], ' ') as first, array_to_string(g[k + 1:m], ' ') as rest
  from (select *, unnest(range(1, m)) as k from candidate)),
cuts as (
  select c.lang, c.g, c.a, k, l.a as l, r.a as r, cast((2000000::hugeint * c.a) // (l.a + r.a) as bigint) as score
  from cut c join f l on l.lang = c.lang and l.p = c.first join f r on r.lang = c.lang and r.p = c.rest),
lowest as (select lang, g, a, l, r, score from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
around as (
  select lang, p, max(a) as most from (
    select lang, a, unnest(list_concat(list_transform(range(1, m), lambda i: g[i:i + 1]),
                                       case when m = 4 then [g[1:3], g[2:4]] else [] end)) as p
    from candidate where m >= 3) group by lang, p),
kept as (select l.* from lowest l left join around on around.lang = l.lang and around.p = l.g where most is null or 100::hugeint * most < 80::hugeint * l.a),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, score
  from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000"""
