"""LM scoring with Brown class-based n-grams (operator 5).

Every training word belongs to one of ``CLASSES`` classes, found by exchange: a word moves to
the class that raises the likelihood of the class bigrams most, given the classes that its
neighbours have now. A text's probability is the product of class transitions and word
emissions, both with additive smoothing: P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Steps. (1) Texts are cut into blocks of about ``BLOCK_TOKENS`` tokens where they are read; a
block gives its distinct words with their counts, and its texts as word numbers. (2) Words are
summed over blocks and numbered by falling frequency; block words get their numbers by a join
and go back to the block (a frequent word is one row per block), where every text is written
with corpus-wide numbers, its counts and its base score. (3) Words seen ``FREQUENT`` times or
more are clustered. They start with the most frequent ones in classes of their own, as Brown's
algorithm does, and the others together. In a sweep, one pass over the texts counts for each
word the classes before and after it (rarer neighbours are one context of their own); counts
travel as packed arrays per range of ``RANGE`` words, are summed per range (in two steps where
there are many blocks), and never exist per occurrence. Summed over words they are the class bigram table, of fixed size.
Each word then weighs its own counts against the table without its own share in it; every
other word moves per sweep (by its number), so that classes do not swing. Sweeps go on until
the likelihood gains less than ``SETTLED`` per token. (4) One more pass gives the rarer words
the class that their contexts fit best. (5) Class transitions of the training texts are
counted, and every text is scored.

The words' classes go out with a pass as one byte per word, up to ``BROADCAST_WORDS`` words;
beyond that each block joins the ranges that it needs. Both ways give the same result.

Learning uses the rows whose crc32(doc_id as text) mod 10 is not 0, all of them, whole; what is
counted grows with the input.

Edge cases: null and empty texts are one end token; texts of any length are whole (one longer
than a block fills a block of its own); unseen words count 0 and belong to the class with most
words seen once, ties to the smaller class; ties between classes go to the smaller one; rows
without doc_id count as the id ''; repeated rows are learnt and scored once each; without
training rows all counts are 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.numbering import numbered
from fleetgrade.llm.common import remainder, word_bytes
from fleetgrade.session import cut_lineage

CLASSES, FREQUENT, SETTLED = 64, 30, 0.01
BLOCK_TOKENS, RANGE, SALTS = 3_000_000, 1_024, 32
BROADCAST_WORDS = 16_000_000
WAITING = 200_000              # word numbers that wait unpacked to be counted
UNPACKED = 200_000             # tokens of packed texts that a task unpacks at once
DENSE = 1 << 24                # counters that a task may hold at once; more are sorted
HELD = 8_000_000               # keys that wait to be sorted, in one buffer
FOLD, ADD, SMOOTH = 10, 0.1, 0.5
WIDE = 2 * (CLASSES + 1)       # contexts: a class or "rarer word" before, the same after
END = b""                      # the end of a text, and what stands before its first word
_RAW = "kind int, block long, idx long, word binary, n long, doc_id long, held_out boolean, toks binary"
_CODED = ("block long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary")
_COUNTS = "range long, salt int, keys binary, counts binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Kind 0: a block's words with their training counts; kind 1: its texts as word numbers."""
    import zlib
    from collections import defaultdict
    from itertools import count

    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    columns = ["kind", "block", "idx", "word", "n", "doc_id", "held_out", "toks"]

    def counted(n, held, size):
        """``n`` with the words of some training texts added."""
        more = np.bincount(np.concatenate(held), minlength=size) if held else np.zeros(size, np.int64)
        more[: len(n)] += n
        return more

    def block(number, rows, index, n):
        words = list(index)
        for lo in range(0, len(words), 20_000):
            part = words[lo: lo + 20_000]
            yield pd.DataFrame({"kind": 0, "block": number, "idx": range(lo, lo + len(part)), "word": part, "n": n[lo: lo + len(part)],
                                "doc_id": None, "held_out": None, "toks": None}, columns=columns).astype(
                                    {"doc_id": "Int64", "held_out": "boolean"})
        for lo in range(0, len(rows), 1_000):
            part = rows[lo: lo + 1_000]
            yield pd.DataFrame({"kind": 1, "block": number, "idx": range(lo, lo + len(part)), "word": None, "n": 0,
                                "doc_id": pd.array([r[0] for r in part], "Int64"), "held_out": [r[1] for r in part],
                                "toks": [r[2] for r in part]}, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def empty():
            numbers = defaultdict(count().__next__)
            numbers[END]        # number 0
            return numbers

        number = TaskContext.get().partitionId() * 1_000_000
        # A block's texts wait packed, and few ids as they are, so a worker holds little beside its words.
        rows, index, tokens = [], empty(), 0
        n, held_ids, waiting = np.zeros(0, np.int64), [], 0
        for b in batches:
            for doc_id, text, held in zip(b["doc_id"].astype("Int64"), b["text"], b["held"], strict=True):
                words = word_bytes(text)
                words.append(END)
                ids = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                rows.append((doc_id, bool(held), zlib.compress(ids.tobytes(), 1)))
                tokens += len(ids)
                if not held:
                    held_ids.append(ids)
                    waiting += len(ids)
                if waiting >= WAITING:
                    n, held_ids, waiting = counted(n, held_ids, len(index)), [], 0
                if tokens >= BLOCK_TOKENS:
                    yield from block(number, rows, index, counted(n, held_ids, len(index)))
                    number, rows, index, tokens = number + 1, [], empty(), 0
                    n, held_ids, waiting = np.zeros(0, np.int64), [], 0
        if rows:
            yield from block(number, rows, index, counted(n, held_ids, len(index)))

    return docs.select("doc_id", "text", (remainder(FOLD) == 0).alias("held")).mapInPandas(run, _RAW)


def _coded(raw: DataFrame, words: DataFrame, total: int, distinct: int) -> DataFrame:
    """Texts with corpus-wide word numbers (-1: not in training), their counts and base scores."""
    import zlib

    import numpy as np
    import pandas as pd

    den = np.log10(total + ADD * (distinct + 1))

    def in_block(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        size = int(found["idx"].max()) + 1 if len(found) else 1
        n, number = np.zeros(size), np.full(size, -1, np.int64)
        at = found["idx"].to_numpy(np.int64)
        n[at], number[at] = found["n"].to_numpy(), found["id"].to_numpy()
        base, out = np.log10(n + ADD) - den, []
        for block, doc_id, held, toks in zip(rows["own"], rows["doc_id"].astype("Int64"), rows["held_out"], rows["toks"], strict=True):
            ids = np.frombuffer(zlib.decompress(toks), np.int32)
            out.append((block, doc_id, held, len(ids), int((n[ids] > 0).sum()), float(base[ids].sum()),
                        zlib.compress(number[ids].astype("<i8" if distinct >= 1 << 31 else "<i4").tobytes(), 1)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CODED.split(", ")]).astype({"doc_id": "Int64"})

    texts = raw.where("kind = 1").select(F.col("block").alias("own"), "doc_id", "held_out", "toks")
    looked = raw.where("kind = 0").select("block", "idx", "word").join(words, "word", "left").select(
        "block", "idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("id", F.lit(-1)).alias("id"))
    return texts.groupBy("own").cogroup(looked.groupBy("block")).applyInPandas(in_block, _CODED)


def _ids(rows, width):
    """All ids of some texts in one array, and where each text begins."""
    import zlib

    import numpy as np

    parts = [np.frombuffer(zlib.decompress(x), width) for x in rows["ids"]]
    size = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, width)), np.concatenate([[0], np.cumsum(size)])


def _parts(texts):
    """The texts of a batch in parts of about ``UNPACKED`` tokens."""
    import numpy as np

    place = np.cumsum(texts["n_tokens"].to_numpy(np.int64)) // UNPACKED
    cuts = np.flatnonzero(np.diff(place)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(texts)]):
        if hi > lo:
            yield texts.iloc[lo:hi]


class Classes:
    """The classes of words 0 .. n-1: a byte each, or a table of ranges where they are too many."""

    def __init__(self, table: DataFrame, words: int, needs: DataFrame | None, limit: int):
        self.table, self.words, self.needs, self.small = table, words, needs, words <= limit

    def over(self, coded: DataFrame, work, schema: str) -> DataFrame:
        """``work(batches of texts, ids -> classes)`` over all texts; words beyond ``words`` have the class CLASSES."""
        import numpy as np
        import pandas as pd

        if self.small:
            rows = self.table.collect()
            every = np.full(self.words + 1, CLASSES, np.uint8)      # the last place is for ids -1 and those beyond
            for r in rows:
                part = np.frombuffer(bytes(r["cls"]), np.uint8)
                every[r["range"] * RANGE: r["range"] * RANGE + len(part)] = part
            count = self.words

            def of(ids):
                return every[np.minimum(ids, count)].astype(np.int32)

            return coded.mapInPandas(lambda batches: work(batches, of), schema)

        def in_block(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            found = found.sort_values("range")
            ranges = found["range"].to_numpy(np.int64)
            held = np.full((len(ranges) + 1, RANGE), CLASSES, np.uint8)
            for i, c in enumerate(found["cls"]):
                held[i, : len(c)] = np.frombuffer(c, np.uint8)

            def of(ids):
                at = np.minimum(np.searchsorted(ranges, ids // RANGE), max(0, len(ranges) - 1))
                known = (ids >= 0) & (ranges[at] == ids // RANGE) if len(ranges) else np.zeros(len(ids), bool)
                return np.where(known, held[np.where(known, at, len(ranges)), np.where(known, ids % RANGE, 0)], CLASSES).astype(np.int32)

            out = [*work(iter([rows]), of)]
            return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

        found = self.needs.join(self.table, "range").select(F.col("block").alias("of"), "range", "cls")
        return coded.groupBy("block").cogroup(found.groupBy("of")).applyInPandas(in_block, schema)


def _pack(keys, counts):
    """Counts of a range: dense in the narrowest type where most places have one, else keys and counts."""
    import zlib

    import numpy as np

    top = int(counts.max(initial=0))
    width = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<i8"
    if len(keys) * 6 > RANGE * WIDE:
        dense = np.zeros(RANGE * WIDE, width)
        dense[keys] = counts
        return b"", width.encode() + zlib.compress(dense.tobytes(), 1)
    steps = np.diff(keys.astype(np.int64), prepend=0).astype("<u4")
    return zlib.compress(steps.tobytes(), 1), width.encode() + zlib.compress(counts.astype(width).tobytes(), 1)


def _unpack(keys, counts):
    """Keys and counts of a packed range (none for empty bytes)."""
    import zlib

    import numpy as np

    if not len(counts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.frombuffer(zlib.decompress(counts[3:]), bytes(counts[:3]).decode()).astype(np.int64)
    if len(keys):
        return np.cumsum(np.frombuffer(zlib.decompress(keys), "<u4").astype(np.int64)), n
    at = np.flatnonzero(n)
    return at, n[at]


def _emit(first: int, flat, count):
    """Sparse counts (word * WIDE + context) as one row per range of words, words from ``first``."""
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    if not len(flat):
        return pd.DataFrame(columns=["range", "salt", "keys", "counts"], dtype=object)
    ranges = np.arange(first // RANGE, (first + int(flat[-1]) // WIDE) // RANGE + 1)
    begin = (ranges * RANGE - first) * WIDE         # the key at which a range begins
    at = np.searchsorted(flat, begin[1:].astype(flat.dtype))
    parts = [(r, b, k, c) for r, b, k, c in zip(ranges, begin, np.split(flat, at), np.split(count, at), strict=True) if len(k)]
    packed = [_pack(k.astype(np.int64) - b, c) for _, b, k, c in parts]
    return pd.DataFrame({"range": [r for r, *_ in parts], "salt": np.full(len(parts), TaskContext.get().partitionId() % SALTS, np.int32),
                         "keys": [k for k, _ in packed], "counts": [c for _, c in packed]})


def _contexts(coded: DataFrame, classes: Classes, first: int, words: int, width: str, blocks: int) -> DataFrame:
    """``range, keys, counts``: context counts of the words ``first .. first + words - 1`` under the classes."""
    import numpy as np
    import pandas as pd

    kind = np.int32 if words * WIDE < 1 << 31 else np.int64

    def tallied(keys):
        """Distinct keys in order and their counts; ``keys`` are sorted in place."""
        keys.sort()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        return keys[at], np.diff(at, append=len(keys)).astype(np.int32)

    def work(batches, of):
        few = words * WIDE <= DENSE
        held, size = np.zeros(words * WIDE, np.int32) if few else np.empty(HELD, kind), 0
        for b in batches:
            for texts in _parts(b[~b["held_out"].astype(bool)]):
                ids, start = _ids(texts, width)
                cls = of(ids)
                end = cls[start[1] - 1]                     # every text ends with END
                before = np.concatenate([[end], cls[:-1]])
                before[start[:-1]] = end
                mine = (ids >= first) & (ids < first + words)
                inner = mine.copy()
                inner[start[1:] - 1] = False                # nothing follows END
                follows = np.flatnonzero(inner)
                keys = np.concatenate([(ids[mine] - first).astype(kind) * WIDE + before[mine],
                                       (ids[follows] - first).astype(kind) * WIDE + (CLASSES + 1) + cls[follows + 1]])
                if few:                     # sorted, so that the counters are met in order
                    if size + len(keys) >= 1 << 31:
                        flat = np.flatnonzero(held)
                        yield _emit(first, flat, held[flat])
                        held[:], size = 0, 0
                    keys, n = tallied(keys)
                    held[keys] += n
                    size += int(n.sum())
                    continue
                while size + len(keys) >= HELD:
                    held[size:], keys, size = keys[: HELD - size], keys[HELD - size:], 0
                    yield _emit(first, *tallied(held))
                held[size: size + len(keys)] = keys
                size += len(keys)
        if few:
            flat = np.flatnonzero(held)
            yield _emit(first, flat, held[flat])
        elif size:
            yield _emit(first, *tallied(held[:size]))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by range: one row per range, equal keys summed."""
        now, held, size = None, [], 0

        def whole():
            total = np.zeros(RANGE * WIDE, np.int64)
            for k, c in held:
                keys, n = _unpack(k, c)
                total[keys] += n            # keys of one row are distinct
            at = np.flatnonzero(total)
            return _pack(at, total[at])

        def row():
            k, c = whole()
            return pd.DataFrame({"range": [now[0]], "salt": [now[1]], "keys": [k], "counts": [c]})

        for b in batches:
            for r, s, k, c in zip(b["range"], b["salt"], b["keys"], b["counts"], strict=True):
                if (r, s) != now:
                    if now is not None:
                        yield row()
                    now, held, size = (r, s), [], 0
                held.append((k, c))
                size += len(k) + len(c)
                if size > 1 << 24:
                    held, size = [whole()], 0
        if now is not None:
            yield row()

    rows = classes.over(coded, work, _COUNTS)
    # A frequent range has a row per task: many are summed in parts first.
    for salt in (F.col("salt"), F.lit(0))[blocks <= 4 * SALTS:]:
        rows = (rows.withColumn("salt", salt.cast("int")).repartition("range", "salt").sortWithinPartitions("range", "salt")
                .mapInPandas(summed, _COUNTS))
    return rows.select("range", "keys", "counts")


def _dense(keys, counts, words: int):
    import numpy as np

    out = np.zeros(RANGE * WIDE)
    at, n = _unpack(keys, counts)
    out[at] = n
    return out.reshape(RANGE, WIDE)[:words]


def _table(contexts: DataFrame):
    """Class x context counts of all words (contexts with their ``cls``)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        total = np.zeros((CLASSES, WIDE))
        for b in batches:
            for keys, counts, cls in zip(b["keys"], b["counts"], b["cls"], strict=True):
                own = np.frombuffer(cls, np.uint8)
                np.add.at(total, own, _dense(keys, counts, len(own)))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "c": total.ravel()[at].astype(np.int64)})

    table = np.zeros(CLASSES * WIDE)
    for r in contexts.select("keys", "counts", "cls").mapInPandas(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():
        table[r["at"]] = r["c"]
    return table.reshape(CLASSES, WIDE)


def likelihood(table) -> float:
    """Class part of the bigram log-likelihood, from the counts of what follows each class."""
    import numpy as np

    n = table[:, CLASSES + 1: CLASSES + 1 + CLASSES]
    safe = lambda x: x * np.log(np.maximum(x, 1))
    return float(safe(n).sum() - safe(n.sum(axis=1)).sum() - safe(n.sum(axis=0)).sum())


def better_classes(counts, own, table):
    """The class of each word that its context counts fit best, its own share taken out of ``own``'s row."""
    import numpy as np

    def fit(t):
        before, after = t[..., : CLASSES + 1], t[..., CLASSES + 1:]
        return np.log(t + SMOOTH), np.log(before.sum(axis=-1) + SMOOTH * (CLASSES + 1)), np.log(after.sum(axis=-1) + SMOOTH * (CLASSES + 1))

    logs, sum_before, sum_after = fit(table)
    n_before, n_after = counts[:, : CLASSES + 1].sum(axis=1), counts[:, CLASSES + 1:].sum(axis=1)
    gain = counts @ logs.T - np.outer(n_before, sum_before) - np.outer(n_after, sum_after)
    if own is not None:
        l, b, a = fit(np.maximum(table[own] - counts, 0))
        gain[np.arange(len(own)), own] = (counts * l).sum(axis=1) - n_before * b - n_after * a
    return gain.argmax(axis=1)


def _assigned(contexts: DataFrame, table, sweep: int | None) -> DataFrame:
    """``range, cls`` after one sweep (``sweep`` None: every word, none of them in the table)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for r, keys, counts, cls in zip(b["range"], b["keys"], b["counts"], b["cls"], strict=True):
                own = np.frombuffer(cls, np.uint8).astype(np.int64)
                dense = _dense(keys, counts, len(own))
                if sweep is None:       # a range may begin with frequent words, which keep their class
                    new = np.where(own < CLASSES, own, better_classes(dense, None, table))
                else:
                    number = r * RANGE + np.arange(len(own))
                    turn = (number * 2_654_435_761 >> 7) % 2 == sweep % 2
                    new = np.where(turn, better_classes(dense, own, table), own)
                out.append(new.astype(np.uint8).tobytes())
            yield pd.DataFrame({"range": b["range"], "cls": out})

    return contexts.select("range", "keys", "counts", "cls").mapInPandas(run, "range long, cls binary")


def cluster(coded: DataFrame, ranges: DataFrame, needs: DataFrame, words: int, frequent: int, width: str,
            blocks: int, limit: int = BROADCAST_WORDS, settled: float = SETTLED) -> tuple[DataFrame, list[float]]:
    """``range, cls`` of all words, and the likelihood of every sweep.

    ``ranges`` (range, ns): the words' counts in the order of their numbers; ``needs`` (block, range).
    """
    import numpy as np
    import pandas as pd

    spark = coded.sparkSession

    def begin(batches):
        for b in batches:
            out = []
            for r, ns in zip(b["range"], b["ns"], strict=True):
                number = r * RANGE + np.arange(len(ns))
                out.append(np.where(number >= frequent, CLASSES, np.minimum(number, CLASSES - 1)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"range": b["range"], "cls": out})

    start = cut_lineage(ranges.mapInPandas(begin, "range long, cls binary"), "lm-classes")
    first = start.where(F.col("range") * RANGE < frequent)
    # Words of the last frequent range that are rarer stay out of the sweeps.
    keep = F.when((F.col("range") + 1) * RANGE <= frequent, F.col("cls")).otherwise(F.substring("cls", 1, frequent % RANGE))
    now = cut_lineage(first.select("range", keep.alias("cls")), "lm-classes")
    seen, best = [], now
    table = np.zeros((CLASSES, WIDE))
    while frequent:
        counted = cut_lineage(_contexts(coded, Classes(now, frequent, needs, limit), 0, frequent, width, blocks).join(now, "range"), "lm-contexts")
        table = _table(counted)
        seen.append(likelihood(table))
        tokens = max(1.0, table[:, CLASSES + 1:].sum())
        if len(seen) > 2 and seen[-1] - seen[-3] < 2 * settled * tokens:     # both halves have had a turn
            break
        best = now
        now = cut_lineage(_assigned(counted, table, len(seen)), "lm-classes")
    if frequent and seen[-1] >= max(seen):
        best = now
    rare = words - frequent
    if not rare:
        return best, seen
    # The last pass: rarer words by the classes around them.
    low = frequent // RANGE
    whole = start.where(F.col("range") >= low).join(best.withColumnRenamed("cls", "have"), "range", "left").select(
        "range", F.when(F.col("have").isNull(), F.col("cls")).otherwise(
            F.concat("have", F.substring("cls", F.octet_length("have") + 1, RANGE))).alias("cls"))
    counted = _contexts(coded, Classes(best, frequent, needs, limit), frequent, rare, width, blocks)
    none = F.unhex(F.lit(""))
    last = whole.join(counted, "range", "left").select("range", "cls", F.coalesce("keys", none).alias("keys"), F.coalesce("counts", none).alias("counts"))
    done = _assigned(last, table, None)
    return cut_lineage(best.where(F.col("range") < low).unionByName(done), "lm-classes"), seen


def score_documents(docs: DataFrame, limit: int = BROADCAST_WORDS, frequent_from: int = FREQUENT) -> DataFrame:
    """Counts, base score, model score and perplexity for every row of ``docs``."""
    import numpy as np
    import pandas as pd

    raw = cut_lineage(_blocks(docs), "lm-blocks", ["kind"])
    every = cut_lineage(raw.where("kind = 0 and n > 0").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    words = numbered(every, [F.desc("n"), "word"], "id")
    total, distinct, frequent = (int(x or 0) for x in words.agg(
        F.sum("n"), F.count("*"), F.sum((F.col("n") >= frequent_from).cast("long"))).first())
    width = "<i8" if distinct >= 1 << 31 else "<i4"
    coded = cut_lineage(_coded(raw, words, total, distinct), "lm-coded")
    ranges = cut_lineage(words.groupBy(F.floor(F.col("id") / RANGE).alias("range")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", "n"))), lambda x: x["n"]).alias("ns")), "lm-ranges")
    needs = (raw.where("kind = 0").select("block", "word").join(words.select("word", F.floor(F.col("id") / RANGE).alias("range")), "word")
             .select("block", "range").distinct())
    table, _ = cluster(coded, ranges, needs, distinct, frequent, width, total // BLOCK_TOKENS, limit)

    def counts(batches):
        n, v, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for cls, ns in zip(b["cls"], b["ns"], strict=True):
                own, ns = np.frombuffer(cls, np.uint8), np.asarray(ns, np.int64)
                np.add.at(n, own, ns)
                np.add.at(v, own, 1)
                np.add.at(once, own, ns == 1)
        yield pd.DataFrame({"cls": np.arange(CLASSES), "n": n, "v": v, "once": once})

    stats = (ranges.join(table, "range").select("cls", "ns").mapInPandas(counts, "cls int, n long, v long, once long")
             .groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("once").alias("once")).collect())
    n_cls, v_cls = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in stats:
        n_cls[r["cls"]], v_cls[r["cls"]] = r["n"], r["v"]
    unseen = max(stats, key=lambda r: (r["once"], -r["cls"]))["cls"] if stats else 0
    base_den, emit_den = np.log10(total + ADD * (distinct + 1)), np.log10(n_cls + ADD * (v_cls + 1))
    classes = Classes(table, distinct, needs, limit)

    def sequences(b, of):
        """Classes of all texts of a batch and of what stands before each token, and where texts begin."""
        ids, start = _ids(b, width)
        cls = of(ids)
        cls = np.where(cls == CLASSES, unseen, cls)
        before = np.concatenate([cls[:1], cls[:-1]])
        before[start[:-1]] = cls[start[1:] - 1]         # END stands before the first word, as it does behind the last
        return cls, before, start

    def moves(batches, of):
        count = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for texts in _parts(b[~b["held_out"].astype(bool)]):
                cls, before, _ = sequences(texts, of)
                count += np.bincount(before * CLASSES + cls, minlength=len(count))
        at = np.flatnonzero(count)
        yield pd.DataFrame({"at": at, "c": count[at]})

    follow = np.zeros(CLASSES * CLASSES)
    for r in classes.over(coded, moves, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():
        follow[r["at"]] = r["c"]
    follow = follow.reshape(CLASSES, CLASSES)
    step = np.log10((follow + SMOOTH) / (follow.sum(axis=1, keepdims=True) + SMOOTH * CLASSES))

    def finish(batches, of):
        for b in batches:
            for part in _parts(b):
                cls, before, start = sequences(part, of)
                n = part["n_tokens"].to_numpy(np.float64)
                # A word's emission is its base score with its class's counts in place of all.
                own = np.add.reduceat(step[before, cls] - emit_den[cls], start[:-1])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "n_tokens": part["n_tokens"],
                                    "n_known": part["n_known"], "train_tokens": total, "base_score": part["base_score"],
                                    "score": part["base_score"].to_numpy() + n * base_den + own})

    return (classes.over(coded, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                        "base_score double, score double")
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


def op5_class_lm(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return score_documents(table(spark, sf_dir, "documents"))
