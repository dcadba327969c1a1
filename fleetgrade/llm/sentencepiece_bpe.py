"""SentencePiece encoding and decoding (operator 4), exact for BPE models with byte fallback.

Encoding by backtracking: one Aho-Corasick pass over a segment gives the longest piece
that starts at each position. Pieces are appended greedily; a piece is accepted only if
it is compatible with its predecessor, that is if merging the two pieces' characters
from scratch gives these two pieces again. Otherwise the next shorter prefix piece is
tried, and when none is left the end position is marked in a bitfield of failed
positions and the last accepted piece is shortened. Merge order is the library's: highest
piece score first, leftmost among equals.

A text is cut into segments at places no piece can cross (before each run of word marks,
around line feeds); each worker keeps the results of recent segments in a bounded table,
so a repeated word costs one look-up. The vocabulary (fixed size, about 0.5 MB) travels
with the function; documents never leave the task that reads them.

Edge cases: null and empty texts have no ids and decode to the empty text; characters
without a piece become byte pieces; texts that hold the names of control pieces are plain
text; repeated rows are encoded row by row; extra columns are ignored unless kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MEMO_SEGMENTS = 500_000     # segments a worker remembers before it starts anew
MEMO_PAIRS = 300_000


def read_model(path: str) -> dict:
    """Pieces, scores and types of a model file (no training, no library state)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    if t.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not t.byte_fallback:
        raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
    return {"pieces": [(p.piece, p.score, p.type) for p in m.pieces], "prefix": n.add_dummy_prefix}


class Bpe:
    """Encoder and decoder of one vocabulary; lives once per Python worker."""

    def __init__(self, model: dict):
        import ahocorasick

        self.prefix = model["prefix"]
        self.names = [p for p, _, _ in model["pieces"]]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model["pieces"]) if t == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i, (_, _, t) in enumerate(model["pieces"]) if t in (2, 3)}
        self.special = self.control | set(self.id_byte)
        self.normal = {p: i for i, (p, _, t) in enumerate(model["pieces"]) if t == 1}
        self.score = {p: s for p, s, t in model["pieces"] if t == 1}
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.memo_ids: dict[str, list[int]] = {}
        # Pieces that merging can produce; others never appear in an encoding.
        self.usable = {p for p in self.normal if len(p) == 1 or self.merge(p) == [p]}
        self.shorter: dict[str, str | None] = {}
        trie = ahocorasick.Automaton()
        for p in self.usable:
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.usable), None)
            trie.add_word(p, len(p))
        trie.make_automaton()
        self.trie = trie
        runs = {p: s for p, s in self.score.items() if len(p) > 1 and not p.strip(MARK)}
        if any(MARK in p.lstrip(MARK) for p in self.normal) or any(p.startswith(MARK * 2) and p not in runs for p in self.normal) \
                or len(set(runs.values())) > 1 or runs and min(self.score.values()) < min(runs.values()):
            raise ValueError("this vocabulary has pieces that cross words")
        self.lines_apart = not any("\n" in p for p in self.normal)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def merge(self, text: str) -> list[str]:
        """Plain merging, used on single pieces and on pairs of pieces only."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) >= MEMO_PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self.merge(a + b) == [a, b]
        return ok

    def pieces(self, seg: str) -> list[str]:
        """Pieces of a segment; characters outside the vocabulary stand alone."""
        n = len(seg)
        longest = [0] * n
        for end, size in self.trie.iter(seg):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        out: list[str] = []
        ends: list[int] = []
        failed = 0  # bit i: no encoding of seg[:i] leads on
        pos = 0
        last = ""
        piece = seg[: longest[0] or 1]
        shorter, known, compatible = self.shorter.get, self.pair_ok.get, self.compatible
        while piece is not None:
            end = pos + len(piece)
            ok = not last or known((last, piece))
            if ok is None:
                ok = compatible(last, piece)
            if ok and not (failed and (failed >> end) & 1):
                out.append(piece)
                if end == n:
                    return out
                ends.append(end)
                pos, last = end, piece
                piece = seg[pos: pos + (longest[pos] or 1)]
                continue
            piece = shorter(piece)
            while piece is None and out:
                failed |= 1 << pos
                piece = shorter(out.pop())
                ends.pop()
                pos = ends[-1] if ends else 0
                last = out[-1] if out else ""
        return self.merge(seg)  # unreachable for a proper merge vocabulary

    def marks(self, k: int) -> list[str]:
        """A run of word marks: its pieces share one score, so the leftmost pair merges first."""
        out: list[int] = []
        size = 0
        while k or size:
            if not size:
                size, k = 1, k - 1
            if out and MARK * (out[-1] + size) in self.score:
                size += out.pop()
            elif k and MARK * (size + 1) in self.score:
                size, k = size + 1, k - 1
            else:
                out.append(size)
                size = 0
        return [MARK * x for x in out]

    def split(self, seg: str) -> list[str]:
        """Pieces of a segment. Runs of marks merge last, after a mark has joined its word."""
        k = len(seg) - len(seg.lstrip(MARK))
        if k < 2:
            return self.pieces(seg)
        if k == len(seg):
            return self.marks(k)
        word = self.pieces(seg[k - 1:])
        return self.marks(k) + word[1:] if word[0] == MARK else self.marks(k - 1) + word

    def ids_of(self, seg: str) -> list[int]:
        ids: list[int] = []
        for p in self.split(seg):
            i = self.normal.get(p)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_id[b] for b in p.encode())
        return ids

    def _segments(self, text: str) -> Iterator[str]:
        norm = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.lines_apart:
            yield from self.segments(norm)
            return
        for k, line in enumerate(norm.split("\n")):
            if k:
                yield "\n"
            yield from self.segments(line)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        memo = self.memo_ids
        for seg in self._segments(text) if text else ():
            got = memo.get(seg)
            if got is None:
                if len(memo) >= MEMO_SEGMENTS:
                    memo.clear()
                got = self.ids_of(seg)
                if len(seg) <= 64:
                    memo[seg] = got
            ids += got
        return ids

    def surface(self, ids: list[int]) -> str:
        """Text of ids, word marks as spaces, runs of byte pieces as UTF-8."""
        names, id_byte = self.names, self.id_byte
        if self.special.isdisjoint(ids):
            return "".join([names[i] for i in ids]).replace(MARK, " ")
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = id_byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.control:
                out.append(names[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if self.prefix and text[:1] == " " else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the joined ids, SHA-256 of the decoded text)."""
        n, ids, back = 0, [], []
        if text:
            memo = self.memo
            for seg in self._segments(text):
                got = memo.get(seg)
                if got is None:
                    if len(memo) >= MEMO_SEGMENTS:
                        memo.clear()
                    own = self.ids_of(seg)
                    got = (len(own), ",".join(map(str, own)), self.surface(own))
                    if len(seg) <= 64:
                        memo[seg] = got
                n += got[0]
                ids.append(got[1])
                back.append(got[2])
        decoded = "".join(back)
        if self.prefix and decoded[:1] == " ":
            decoded = decoded[1:]
        return n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_WORKER: dict[str, Bpe] = {}


def coder(model: dict) -> Bpe:
    """The worker's coder of this model (by a digest of all of it), built once per Python worker."""
    key = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Bpe(model)
    return _WORKER[key]


def encode_documents(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row: the operator's own output.

    With ``decoded``, also the ``text`` that the ids decode to, by the same worker's coder.
    """
    import numpy as np
    import pandas as pd

    model = read_model(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            for at in range(0, len(b), 500):  # ids take more room than texts
                part = b.iloc[at: at + 500]
                ids = [np.array(c.encode(t), np.int32) for t in part["text"]]
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_tokens": [len(i) for i in ids], "ids": ids})
                yield out.assign(text=[c.decode(i.tolist()) for i in ids]) if decoded else out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids array<int>" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with ``ids``) and the ``text`` its ids decode to."""
    import pandas as pd

    model = read_model(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            texts = [None if ids is None else c.decode(list(ids)) for ids in b["ids"]]
            yield b.assign(doc_id=b["doc_id"].astype("Int64"), text=texts)

    return encoded.mapInPandas(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text for every row."""
    import pandas as pd

    model = read_model(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            got = [c.digest(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [g[0] for g in got],
                                "ids_sha256": [g[1] for g in got], "decoded_sha256": [g[2] for g in got]})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from fleetgrade.llm.common import table

    return token_digests(table(spark, sf_dir, "documents"), model_path or default_model())
