"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled parts: the normaliser (the rules that the file states: a space in front, runs of spaces, U+2581 for
spaces; a file with a table of character rewrites is refused), the arcs (one per piece of the file) and byte
fallback (an arc over any one character that no piece covers).  The file is a BPE model, whose merges are no additive piece costs.  They are expressed as weights on pairs of arcs: a pair costs 0
if merging the two pieces' joint text gives just these two pieces, and infinity otherwise.  Composed with an
input, the transducer has exactly one path of finite cost through every prefix, so the shortest path of the
tropical semiring is found in one pass that keeps the last arc of each prefix.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches
from .tokenizers import library, tokenizer_path

SPACE = "▁"
#: A chunk is a run of spaces with what follows up to the next; no piece reaches past one.  Longer chunks than LONG go by scalar steps.
CHUNK, LONG = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), 48
BLOCK = 4_000_000
#: Distinct chunks whose ids a worker remembers, some 100 bytes each.
KNOWN = 400_000
_SLOTS = 1 << 21
_PAIR_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes.astype(np.uint64)) * _MULT
    return h ^ (h >> np.uint64(29))


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Normaliser:
    """What a piece file says is done to a text first."""

    prefix: bool = True
    collapse: bool = True

    @classmethod
    def of(cls, model: bytes) -> Normaliser:
        # Fixed values of the file format: field 3 of a model is its normaliser; there, 2 is the table of rewrites,
        # 3 a space in front, 4 removal of extra spaces, 5 the mark for spaces.
        spec = dict(proto_fields(next((v for k, v in proto_fields(model) if k == 3), b"")))
        if spec.get(2) or not spec.get(5, 1):
            raise ValueError("a table of character rewrites, or spaces without a mark, is not supported")
        return cls(bool(spec.get(3, 1)), bool(spec.get(4, 1)))

    def __call__(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)


class Transducer:
    """Arcs and pair weights of one piece file."""

    def __init__(self, name: str) -> None:
        sp = library(name)
        self.rules = Normaliser.of(Path(tokenizer_path(name)).read_bytes())
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {self.text[i]: i for i in plain}
        self.rank = {self.text[i]: -sp.get_score(i) for i in plain}
        self.bytes = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(self.text[i][3:5], 16)] = i
        #: The inverse transducer: the bytes of every piece.
        self.raw = [t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for t in self.text]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        #: ids (little-endian 32-bit) of short chunks met before.
        self.known: dict[str, bytes] = {}
        self.longest = max(map(len, self.ids))
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("pieces that reach over a space are not supported")
        if len(set(self.bytes)) < 256:
            raise ValueError("the file has no byte fallback")
        # Characters without a piece get numbers from n on, so that every arc is a number.
        self.extra: dict[str, int] = {}
        self.extra_text: list[str] = []
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_ok = np.zeros(1 << _PAIR_BITS, np.uint64), np.zeros(1 << _PAIR_BITS, bool)
        hashes = np.zeros(len(plain), np.uint64)
        for k, i in enumerate(plain):
            h = np.zeros(1, np.uint64)
            for c in self.text[i]:
                h = _roll(h, np.array([ord(c)]))
            hashes[k] = h[0]
        order = np.argsort(hashes)
        self.hashes, self.hashed_ids = hashes[order], np.array(plain, np.int32)[order]
        assert len(np.unique(self.hashes)) == len(plain)
        self.slots = np.full(_SLOTS, -1, np.int32)
        at = (self.hashes >> np.uint64(11)) % np.uint64(_SLOTS)
        self.slots[at] = np.arange(len(at))
        self.crowded = np.zeros(_SLOTS, bool)  # slots of several pieces are searched
        values, counts = np.unique(at, return_counts=True)
        self.crowded[values[counts > 1]] = True

    def arc_text(self, arc: int) -> str:
        return self.text[arc] if arc < len(self.text) else self.extra_text[arc - len(self.text)]

    def char_arc(self, c: str) -> int:
        """The arc over one character: its piece, or one that stands for its bytes."""
        arc = self.ids.get(c)
        if arc is None:
            arc = self.extra.get(c)
            if arc is None:
                arc = self.extra[c] = len(self.text) + len(self.extra_text)
                self.extra_text.append(c)
        return arc

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: best rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def free(self, a: int, b: int) -> bool:
        """True if the pair of arcs costs 0, False if it costs infinity."""
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            x, y = self.arc_text(a), self.arc_text(b)
            ok = self.pairs[key] = self.merged(x + y) == [x, y]
        return ok

    def free_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """free() of arrays, through a table of one slot for each hash; a pair that lost its slot is asked for anew."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = (keys * _MULT) >> np.uint64(64 - _PAIR_BITS)
        known = self.pair_keys[slot] == keys
        out = self.pair_ok[slot]
        if not known.all():
            if len(self.pairs) > 4_000_000:  # bounded memory: start anew
                self.pairs = {}
            fresh, back = np.unique(keys[~known], return_inverse=True)
            ok = np.array([self.free(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], bool)
            out[~known] = ok[back]
            where = (fresh * _MULT) >> np.uint64(64 - _PAIR_BITS)
            one = np.unique(where, return_index=True)[1]
            self.pair_keys[where[one]], self.pair_ok[where[one]] = fresh[one], ok[one]
        return out

    def shortest(self, chunk: str) -> list[int]:
        """Arcs of the shortest path over one chunk, step by step."""
        n = len(chunk)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for length in range(min(self.longest, j), 0, -1):
                own = self.char_arc(chunk[j - 1]) if length == 1 else self.ids.get(chunk[j - length : j])
                if own is not None and (j == length or self.free(last[j - length], own)):
                    last[j], size[j] = own, length
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        slot = (h >> np.uint64(11)) % np.uint64(_SLOTS)
        k = self.slots[slot]
        many = self.crowded[slot]
        if many.any():
            k[many] = np.minimum(np.searchsorted(self.hashes, h[many]), len(self.hashes) - 1)
        return np.where((k >= 0) & (self.hashes[k] == h), self.hashed_ids[k], -1)

    def shortest_all(self, chunks: list[str]) -> list[bytes]:
        """ids (little-endian 32-bit) of the shortest paths of distinct chunks, those of one length at a time."""
        out: list = [None] * len(chunks)
        by_length: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                out[i] = self.with_bytes(np.array(self.shortest(c), "<i4")).tobytes()
            else:
                by_length.setdefault(len(c), []).append(i)
        for n, index in by_length.items():
            codes = np.frombuffer("".join(chunks[i] for i in index).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            m, most = len(index), min(n, self.longest)
            arcs = np.full((most + 1, n + 1, m), -1, np.int32)
            h = np.zeros((m, n), np.uint64)
            for length in range(1, most + 1):
                h = _roll(h[:, : n - length + 1], codes[:, length - 1 :])
                arcs[length, length:] = self.lookup(h).T
            bare = arcs[1, 1:] < 0
            if bare.any():
                arcs[1, 1:][bare] = [self.char_arc(chr(c)) for c in codes.T[bare].tolist()]
            there = (arcs >= 0).any(axis=2)
            last, size = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32)
            for j in range(1, n + 1):
                open_ = np.arange(m)
                for length in range(min(most, j), 0, -1):
                    if not there[length, j]:
                        continue
                    own = arcs[length, j, open_]
                    has = own >= 0  # then: has an arc that is free
                    rows, own = open_[has], own[has]
                    ok = np.ones(len(rows), bool) if j == length else self.free_pairs(last[j - length, rows], own)
                    last[j, rows[ok]], size[j, rows[ok]] = own[ok], length
                    has[has] = ok
                    open_ = open_[~has]
                    if not len(open_):
                        break
            # Back from the end; paths are read off column by column, then cut out of one run of bytes.
            at, cols, every = np.full(m, n), [], np.arange(m)
            while (at > 0).any():
                cols.append(np.where(at > 0, last[at, every], -1))
                at = at - size[at, every]
            path = np.array(cols, "<i4").T[:, ::-1]
            ends = 4 * np.cumsum((path >= 0).sum(axis=1))
            run = path[path >= 0].tobytes()
            for i, a, b in zip(index, [0, *ends.tolist()], ends.tolist(), strict=False):
                out[i] = run[a:b]
            for k in np.flatnonzero((path >= len(self.text)).any(axis=1)).tolist():
                out[index[k]] = self.with_bytes(path[k][path[k] >= 0]).tobytes()
        return out

    def with_bytes(self, arcs: np.ndarray) -> np.ndarray:
        """Arcs that stand for bytes replaced by the byte pieces."""
        n = len(self.text)
        if not len(arcs) or arcs.max() < n:
            return arcs
        out = []
        for a in arcs.tolist():
            out += [a] if a < n else [self.bytes[b] for b in self.extra_text[a - n].encode("utf-8", "surrogatepass")]
        return np.array(out, "<i4")

    def path_ids(self, chunks: list[str]) -> list[bytes]:
        """ids of distinct chunks; shortest paths are searched only for those not met before."""
        if len(self.known) > KNOWN:  # bounded memory: start anew
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        found = dict(zip(new, self.shortest_all(new), strict=True))
        out = [self.known.get(c) or found[c] for c in chunks]
        self.known |= {c: i for c, i in found.items() if len(c) <= LONG}
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of whole texts."""
        lists = [CHUNK.findall(self.rules(t)) for t in texts]
        flat = [c for x in lists for c in x]
        if not flat:
            return [np.empty(0, np.int32)] * len(texts)
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        own = self.path_ids(list(distinct))
        size = np.array([len(a) // 4 for a in own])
        start = np.concatenate([[0], np.cumsum(size)])
        pool = np.frombuffer(b"".join(own), "<i4")
        each = size[codes]
        ends = np.cumsum(each)
        # Each token's place in the pool: its chunk's start and its place in the chunk.
        ids = pool[np.repeat(start[codes] - (ends - each), each) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, lists)])]
        return [ids[a:b] for a, b in zip(upto, upto[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: the pieces' bytes as UTF-8, the space of the normaliser dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.rules.prefix and text[:1] == " " else text


@lru_cache(None)
def transducer(name: str) -> Transducer:
    return Transducer(name)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < BLOCK:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int), text.

    Null texts count as empty and have no ids; texts of any length are encoded whole.  Repeated rows and null ids keep
    rows of their own; extra columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for p in parts:
            texts = p["text"].tolist()
            for a, b in _blocks(texts):
                yield pd.DataFrame({"doc_id": p["doc_id"].iloc[a:b].astype("Int64"), "ids": [x for x in t.encode(texts[a:b])], "text": texts[a:b]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "doc_id bigint, ids array<int>, text string")


def decode_ids(rows: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """rows with ``decoded``: the text of an array of ids; null for null, empty for none; a column of that name is replaced."""

    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(model)
        for p in parts:
            yield pd.Series([None if x is None else t.decode(x.tolist()) for x in p], dtype=object)

    return rows.withColumn("decoded", decoded(ids_col))


def encode_digest(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text, U+2581 as a space).

    Nulls, repeated rows, extra columns, long texts and empty tables as in encode_documents().
    """
    bound_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for p in parts:
            texts = p["text"].tolist()
            for a, b in _blocks(texts):
                own = t.encode(texts[a:b])
                back = [t.decode(x.tolist()) for x in own]
                yield pd.DataFrame(
                    {
                        "doc_id": p["doc_id"].iloc[a:b].astype("Int64").to_numpy(), "n_ids": [len(x) for x in own], "ids_crc32": [zlib.crc32(x.tobytes()) for x in own],
                        "round_trip": [x == s.replace(SPACE, " ") for x, s in zip(back, texts[a:b], strict=True)],
                    }
                ).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean")
