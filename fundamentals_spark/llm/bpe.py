"""Byte-level BPE: texts to token ids and back.

Two tiers. A minimal perfect hash over the vocabulary gives the id of a whole pre-token that is a vocabulary entry (one
comparison of bytes confirms it). A pre-token that is none is merged: its bytes form a linked list, a heap holds the ranks
of neighbouring parts, and the lowest rank, leftmost first, is merged until no pair has a rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm.bytehash import mix

#: Pre-tokens that a worker keeps with their ids, in two generations, and the longest it keeps; only speed depends on them.
MEMO, MEMO_BYTES = 300_000, 64
_MASK = 2**64 - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: In texts without characters that match this, ``re``'s classes agree with the Unicode categories L and N.
_UNCOMMON = re.compile("[^\x00-ɏ]|[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]")
#: The contractions begin with a character that no earlier-placed alternative can begin with, so letters and digits may be tried first.
_REORDERED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|", r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)|")
_CLASSES = (("[^\\s\\p{L}\\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"))


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file with lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets, the fullest first try displacements until all their slots are free."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.m = n, max(1, n // 3)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two tokens have one 64-bit hash")
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.shift = np.zeros(self.m, dtype=np.int64)
        self.at = np.full(n, -1, dtype=np.int32)
        used = np.zeros(n, dtype=bool)
        sizes = np.diff(first)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            left = np.flatnonzero(sizes == size)
            d = 0
            while len(left):  # all waiting buckets of this size try the same displacement
                d += 1
                members = order[first[left][:, None] + np.arange(size)]
                slots = self._slots(h[members], np.int64(d))
                fits = ~used[slots].any(axis=1)
                fits &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                row = np.flatnonzero(fits)
                _, taken_by = np.unique(slots[row], return_index=True)
                won = np.bincount(taken_by // size, minlength=len(row)) == size
                row = row[won]
                used[slots[row]] = True
                self.at[slots[row]] = members[row]
                self.shift[left[row]] = d
                left = np.delete(left, row)
        free = iter(np.flatnonzero(~used))
        for b in np.flatnonzero(sizes == 1):  # a bucket of one names its slot directly
            slot = int(next(free))
            self.shift[b] = -slot - 1
            self.at[slot] = order[first[b]]
        self.shift, self.at = self.shift.tolist(), self.at.tolist()

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        return (mix(h ^ (np.asarray(d).astype(np.uint64) * _STEP)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """The only index of the vocabulary that ``key`` can have."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        if d < 0:
            return self.at[-d - 1]
        h ^= (d * 0x9E3779B97F4A7C15) & _MASK
        h = ((h ^ (h >> 32)) * 0x9E3779B97F4A7C15) & _MASK
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
        return self.at[(h ^ (h >> 32)) % self.n]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by a heap over linked bytes."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    shift = 16 if n < 1 << 16 else 40
    mask = (1 << shift) - 1
    end = list(range(1, n + 1))  # where the part that begins here ends; 0: no part begins here
    before = list(range(-1, n))
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append(((r << shift) | i) << shift | (i + 2))
    heapq.heapify(heap)
    while heap:
        x = pop(heap)
        e, i = x & mask, (x >> shift) & mask
        m = end[i]
        if not m or m >= n or m >= e or end[m] != e:
            continue  # one of the two parts is no longer there
        end[i] = e
        end[m] = 0
        if e < n:
            before[e] = i
            stop = end[e]
            r = get(piece[i:stop])
            if r is not None:
                push(heap, ((r << shift) | i) << shift | stop)
        p = before[i]
        if p >= 0:
            r = get(piece[p:e])
            if r is not None:
                push(heap, ((r << shift) | p) << shift | e)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memo(dict):
    """Ids by pre-token; one that is missing goes through the two tiers."""

    def __init__(self, tokens: list[bytes], ranks: dict[bytes, int], perfect: PerfectHash, old: dict[str, tuple[int, ...]]):
        self.tokens, self.ranks, self.perfect, self.old = tokens, ranks, perfect, old

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.old.get(text)
        if ids is None:
            piece = text.encode()
            i = self.perfect.find(piece)
            ids = (i,) if self.tokens[i] == piece else tuple(merge_bytes(piece, self.ranks))
            if len(piece) > MEMO_BYTES:
                return ids
        self[text] = ids
        return ids


class Encoder:
    """Encodes and decodes whole texts; holds a vocabulary, its perfect hash and a bounded memo."""

    def __init__(self, tokens: list[bytes], perfect: PerfectHash, pattern: str):
        self.tokens, self.perfect = tokens, perfect
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.slow = regex.compile(pattern)
        common = pattern.replace(*_REORDERED)
        for a, b in _CLASSES:
            common = common.replace(a, b)
        self.fast = re.compile(common) if r"\p" not in common else self.slow
        self.memo = Memo(tokens, self.ranks, perfect, {})

    def split(self, text: str) -> list[str]:
        return (self.slow if _UNCOMMON.search(text) else self.fast).findall(text)

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            plain = dict(self.memo)
            self.memo = Memo(self.tokens, self.ranks, self.perfect, plain)
        return array("I", chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """id_col and the named outputs for every row, in one pass over whole texts.

    Outputs: n_tokens long, ids array<int>, decoded binary (from the ids), ids_sha256 and decoded_sha256 string. A null
    or empty text has no ids. Rows are treated alone, so repeated rows get equal results and an empty table gives an empty
    one; other columns are not read. ``vocabulary`` is the path of a rank file that the driver reads; the file's tokens
    and the hash go to the tasks with the function, as their size is the vocabulary's and does not grow with the data.
    """
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    tokens = load_ranks(vocabulary)
    key = hashlib.sha256(repr((vocabulary, pattern)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens), pattern))
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(*shared.value)
        encoder = _encoders[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
                cols = {"doc_id": part.column("doc_id")}
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    raw = [encoder.decode(x) for x in ids]
                for name in outputs:
                    if name == "n_tokens":
                        value = [len(x) for x in ids]
                    elif name == "ids":
                        cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                        flat = np.frombuffer(b"".join(x.tobytes() for x in ids), dtype=np.uint32).astype(np.int32)
                        cols[name] = pa.ListArray.from_arrays(cuts, pa.array(flat))
                        continue
                    elif name == "ids_sha256":
                        value = [hashlib.sha256(np.frombuffer(x, dtype=np.uint32).astype("<u4").tobytes()).hexdigest() for x in ids]
                    elif name == "decoded":
                        value = raw
                    else:
                        value = [hashlib.sha256(x).hexdigest() for x in raw]
                    cols[name] = pa.array(value, type=kinds[name][1])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = source.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {kinds[n][0]}" for n in outputs))
    return out.withColumnRenamed("doc_id", id_col)


def decode_ids(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and ``decoded`` (binary) from a column of ids; a null array decodes to null, an empty one to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        token = shared.value.__getitem__
        for batch in batches:
            raw = [None if x is None else b"".join(map(token, x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, type=pa.binary())], names=["doc_id", "decoded"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, decoded binary").withColumnRenamed("doc_id", id_col)
