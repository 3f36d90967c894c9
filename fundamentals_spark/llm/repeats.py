"""Suffix-array deduplication: every byte in a string of LENGTH bytes that also starts earlier goes.

Two equal strings of LENGTH bytes select equal anchors: a position whose GRAM-byte hash is lowest in some window of that
length. So anchors, about one for 35 bytes, find all repeats. Anchors travel with a digest of the bytes of their whole context,
everything that a window around them can hold. Contexts of one gram with equal digests (64 bits of SHA-256, beside the 64
bits of the gram's polynomial hash) are equal: all but the earliest go, without moving the text. Where one gram has
several contexts, their suffixes (and prefixes, read backwards) are sorted by mergesort; two suffixes are compared at their
common extension, which a binary search over polynomial prefix hashes finds; bytes then confirm the extensions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm import bytehash
from fundamentals_spark.llm.common import materialize

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
CHUNK = 1 << 20
#: Contexts that a sorting task gets on average, and contexts of one gram (about 3 KB of arrays each) that it can hold; a gram
#: with more is split by its windows.
TASK_ROWS, SORT_ROWS = 10_000, 50_000
_LAST = np.iinfo(np.int64).max
_TABLE2 = np.random.default_rng(77).integers(1, 2**64, 256, dtype=np.uint64)
_BASE2 = bytehash.BASE ^ 0x5555555555555554
_INVERSE2 = pow(_BASE2, -1, 2**64)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of ``width`` values."""
    n, have = len(a) - width + 1, 1
    while 2 * have <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[:n], a[width - have : width - have + n])


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 64 bits of the SHA-256 of byte ranges."""
    raw, sha = memoryview(buf), hashlib.sha256
    return np.frombuffer(b"".join([sha(raw[a:b]).digest()[:8] for a, b in zip(start.tolist(), end.tolist(), strict=True)]), dtype=np.uint64)


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors in a buffer of rows, their gram and context hashes, and the context's reach to the left and right."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < LENGTH:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    prefix = bytehash.prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = bytehash.mix(bytehash.substring_hash(prefix, at, at + GRAM))
    low = _slide(gram, REACH + 1, np.minimum)
    lengths = np.diff(offsets)
    room = np.repeat(offsets[1:], lengths)[: len(low)] - np.arange(len(low)) >= LENGTH
    low = np.where(room, low, np.uint64(0))
    edge = np.zeros(REACH, dtype=np.uint64)
    p = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), REACH + 1, np.maximum) == gram)
    row = np.searchsorted(offsets, p, side="right") - 1
    left = np.minimum(REACH, p - offsets[row])
    right = np.minimum(REACH, offsets[row + 1] - p - GRAM)
    fits = right >= 0
    p, left, right = p[fits], left[fits], right[fits]
    context = bytehash.mix(digests(buf, p - left, p + GRAM + right) + (left * 256 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return p, gram[p], context, left, right


class Suffixes:
    """Suffixes of one byte array with limited lengths, compared by prefix hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buf, self.start, self.length = np.append(buf, np.uint8(0)), start, length
        self.prefix = bytehash.prefix_hash(buf)
        self.inverse = bytehash.powers(bytehash.INVERSE, len(buf) + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over hashes."""
        a, b = self.start[i], self.start[j]
        lo, hi = np.zeros(len(i), dtype=np.int64), np.minimum(self.length[i], self.length[j])
        pa_, pb = self.prefix[a], self.prefix[b]
        ia, ib = self.inverse[a], self.inverse[b]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[a + mid] - pa_) * ia == (self.prefix[b + mid] - pb) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        li, lj = self.length[i], self.length[j]
        inner = (n < li) & (n < lj)
        return np.where(inner, self.buf[self.start[i] + np.where(inner, n, 0)] < self.buf[self.start[j] + np.where(inner, n, 0)], li < lj)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order by group, then suffix: mergesort of all groups side by side, each merge by ranks in the sibling run."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(g)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while (count > width).any():
            at = np.flatnonzero(count > width)
            idx = at - begin[at]
            run = idx // width
            lo = np.minimum((run ^ 1) * width, count[at])
            base, hi = lo.copy(), np.minimum(lo + width, count[at])
            mine, even = order[at], run % 2 == 0
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                other, own, e = order[begin[at[open_]] + mid], mine[open_], even[open_]
                lower = self.less(np.where(e, other, own), np.where(e, own, other))
                right = np.where(e, lower, ~lower)  # equal ones of the left run stay in front
                lo[open_], hi[open_] = np.where(right, mid + 1, lo[open_]), np.where(right, hi[open_], mid)
            order[begin[at] + (run & ~1) * width + idx - run * width + lo - base] = mine
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each with the one before it in order; -1 at a group's first. Bytes confirm each length."""
        out = np.full(len(order), -1, dtype=np.int64)
        k = np.flatnonzero(np.concatenate([[False], group[order[1:]] == group[order[:-1]]])) if len(order) else np.zeros(0, dtype=np.int64)
        i, j = order[k - 1], order[k]
        n = self.common(i, j)
        if n.max(initial=0) > 0:
            span = np.arange(int(n.max(initial=0)))
            for lo in range(0, len(k), 4096):
                s = slice(lo, lo + 4096)
                inside = span[None, :] < n[s, None]
                differ = inside & (self.buf[np.where(inside, self.start[i[s], None] + span, 0)] != self.buf[np.where(inside, self.start[j[s], None] + span, 0)])
                hit = differ.any(axis=1)
                n[s] = np.where(hit, differ.argmax(axis=1), n[s])  # a collision: the first byte that differs ends the extension
        out[k] = n
        return out


def covered(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, start, end) of the bytes around anchors that windows cover whose equal starts earlier, among contexts of equal grams."""
    n = len(group)
    buf = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(left + GRAM + right)])[:-1]
    fwd = Suffixes(buf, at + left, GRAM + right)
    bwd = Suffixes(buf[::-1].copy(), len(buf) - (at + left), left)
    orders = [s.sort(group) for s in (fwd, bwd)]
    lcps = [s.neighbours(o, group) for s, o in zip((fwd, bwd), orders, strict=True)]
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((pos, doc))] = np.arange(n)
    lo, hi = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    cls = np.empty((2, n), dtype=np.int64)
    for d in range(REACH + 1):  # windows that begin d bytes before the gram
        for k, least in enumerate((LENGTH - d, d)):
            cls[k, orders[k]] = np.cumsum(lcps[k] < least)
        fits = np.flatnonzero((left >= d) & (right >= REACH - d))
        key = cls[0, fits] * (n + 1) + cls[1, fits]
        order = np.lexsort((rank[fits], key))
        later = fits[order[1:][key[order[1:]] == key[order[:-1]]]]
        lo[later] = np.where(lo[later] < 0, d, lo[later])
        hi[later] = d
    some = np.flatnonzero(lo >= 0)
    return some, pos[some] - hi[some], pos[some] - lo[some] + LENGTH


#: Open rows: an anchor at ``pos`` of ``doc`` whose context reaches ``reach // 256`` left and ``reach % 256`` right. Others: settled bytes from ``pos`` on, ``reach`` of them.
ANCHOR = "open boolean, g long, c long, doc long, pos long, reach int"


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document (and version, the high bits of places) that touch become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    rank = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (start[1:] >> 32 != start[:-1] >> 32)])) << 33
    base = rank - (start >> 32 << 32)
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate([[True], start[1:] + base[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], start[new], reach[last] - base[last]


def _find(batch: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Anchors of a group of rows; of equal contexts all but the earliest are settled at once."""
    p, g, c, left, right = anchors(buf, offsets)
    row = np.searchsorted(offsets, p, side="right") - 1
    doc = batch.column("doc").to_numpy()[row]
    pos = p - offsets[row] + (batch.column("version").to_numpy().astype(np.int64)[row] << 32)
    order = np.lexsort((pos, doc, c, g))
    g, c, doc, pos, left, right = g[order], c[order], doc[order], pos[order], left[order], right[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])[: len(g)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    done = ~new & ((doc != doc[first]) | (pos != pos[first]))  # a row that shares its id and place with the first is that row again
    d, a, b = _joined(doc[done], pos[done] - left[done], pos[done] + GRAM + right[done])
    none = np.zeros(len(d), dtype=np.int64)
    cols = [np.append(g[new].view(np.int64), none), np.append(c[new].view(np.int64), none), np.append(doc[new], d), np.append(pos[new], a), np.append((left * 256 + right)[new], b - a).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(cols[0])) < int(new.sum())), *map(pa.array, cols)], names=["open", "g", "c", "doc", "pos", "reach"])


def _settle(batches):
    """Streams open anchors in order of (g, c, doc, pos): a later one of an equal context is settled; the earliest of each
    context stays open if its gram has another context. Settled rows pass. Keeps one row between batches."""
    held = None  # the earliest of the last context: g, c, doc, pos, reach, and whether it waits for another context
    for batch in batches:
        table = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "c", "doc", "pos", "reach")]
        is_open = batch.column("open").to_numpy(zero_copy_only=False)
        passed = [x[~is_open] for x in table]
        g, c, doc, pos, reach = (x[is_open] for x in table)
        if not len(g):
            yield batch
            continue
        before = held or (None, None, None, None, None, False)
        new_g = np.concatenate([[before[0] is None or g[0] != before[0]], g[1:] != g[:-1]])
        new = new_g | np.concatenate([[before[1] is None or c[0] != before[1]], c[1:] != c[:-1]])
        rep = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
        rd = np.where(rep >= 0, doc[rep], before[2] if held else 0)
        rp = np.where(rep >= 0, pos[rep], before[3] if held else 0)
        settled = ~new & ((doc != rd) | (pos != rp))
        first = np.flatnonzero(new)
        out_open = np.zeros(len(g), dtype=bool)
        extra = []
        if len(first):
            again = ~new_g[first]  # a further context of the gram
            follows = np.append(again[1:], False)
            out_open[first[again | follows]] = True
            if held and held[5] and again[0]:
                extra = [held[:5]]
            k = first[-1]
            held = (g[k], c[k], doc[k], pos[k], reach[k], not again[-1])
        left, right = reach[settled] // 256, reach[settled] % 256
        d, a, b = _joined(np.append(passed[2], doc[settled]), np.append(passed[3], pos[settled] - left), np.append(passed[3] + passed[4], pos[settled] + GRAM + right))
        none = np.zeros(len(d), dtype=np.int64)
        opened = [np.append(x[out_open].astype(np.int64), np.array([e[i] for e in extra], dtype=np.int64)) for i, x in enumerate((g, c, doc, pos, reach))]
        cols = [np.append(x, y) for x, y in zip(opened, (none, none, d, a, b - a), strict=True)]
        cols[4] = cols[4].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cols[0])) < len(opened[0])), *map(pa.array, cols)], names=["open", "g", "c", "doc", "pos", "reach"])


#: Open rows: a window that begins d bytes before the gram of an anchor, with two hashes. Others: an anchor whose windows from d to h1 are covered.
WINDOW = "open boolean, doc long, pos long, d int, h1 long, h2 long"


def _window_rows(is_open: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(is_open), *(pa.array(x.astype(k)) for x, k in zip(cols, kinds))], names=["open", "doc", "pos", "d", "h1", "h2"])


def _ranges(doc: np.ndarray, pos: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """doc, pos, smallest and greatest d of each anchor."""
    order = np.lexsort((d, pos, doc))
    doc, pos, d = doc[order], pos[order], d[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])[: len(doc)]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)[: int(new.sum())]
    return [doc[new], pos[new], d[new], d[last], np.zeros(int(new.sum()), dtype=np.int64)]


def _windows(batches):
    """Every window of LENGTH bytes in the anchors' contexts; of equal ones in a batch the earliest stays open, the others are covered."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            buf, offsets = bytehash.text_buffer(part.column("context"))
            left = part.column("reach").to_numpy().astype(np.int64) // 256
            row = np.repeat(np.arange(part.num_rows), np.maximum(np.diff(offsets) - LENGTH + 1, 0))
            start = offsets[row] + np.arange(len(row)) - np.searchsorted(row, row)
            one = bytehash.mix(bytehash.substring_hash(bytehash.prefix_hash(buf), start, start + LENGTH)).view(np.int64)
            two = bytehash.mix(bytehash.substring_hash(bytehash.prefix_hash(buf, _TABLE2, _BASE2), start, start + LENGTH, _INVERSE2)).view(np.int64)
            doc, pos, d = part.column("doc").to_numpy()[row], part.column("pos").to_numpy()[row], left[row] - start + offsets[row]
            order = np.lexsort((pos, doc, d, two, one))
            doc, pos, d, one, two = (x[order] for x in (doc, pos, d, one, two))
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (d[1:] != d[:-1])])[: len(one)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = ~new & ((doc != doc[first]) | (pos != pos[first]))
            closed = _ranges(doc[gone], pos[gone], d[gone])
            cols = [np.append(x[new], y) for x, y in zip((doc, pos, d, one, two), closed)]
            yield _window_rows(np.arange(len(cols[0])) < int(new.sum()), cols)


def _later_windows(batches):
    """Streams open windows in order of (h1, h2, d, doc, pos): all but the earliest of a class are covered. Keeps one row between batches."""
    held = None
    for batch in batches:
        is_open = batch.column("open").to_numpy(zero_copy_only=False)
        doc, pos, d, one, two = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("doc", "pos", "d", "h1", "h2"))
        passed = [x[~is_open] for x in (doc, pos, d, one, two)]
        doc, pos, d, one, two = (x[is_open] for x in (doc, pos, d, one, two))
        cols = passed
        if len(doc):
            if held is not None:
                doc, pos, d, one, two = (np.append(h, x) for h, x in zip(held, (doc, pos, d, one, two)))
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (d[1:] != d[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = ~new & ((doc != doc[first]) | (pos != pos[first]))
            cols = [np.append(x, y) for x, y in zip(passed, _ranges(doc[gone], pos[gone], d[gone]))]
            k = first[-1]
            held = [x[k : k + 1] for x in (doc, pos, d, one, two)]
        yield _window_rows(np.zeros(len(cols[0]), dtype=bool), cols)


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """Spans as ``covered`` finds them, for grams with more contexts than a sorting task holds: equal windows meet by their
    hashes in one shuffle and stream in order, so that no task holds all contexts of a gram, nor a class of windows."""
    w = contexts.mapInArrow(_windows, WINDOW).repartition(F.when(F.col("open"), F.col("h1")).otherwise(F.xxhash64("doc", "pos")))
    w = w.sortWithinPartitions("h1", "h2", "d", "doc", "pos").mapInArrow(_later_windows, WINDOW)
    later = w.groupBy("doc", "pos").agg(F.min("d").alias("lo"), F.max("h1").alias("hi"))
    return later.select("doc", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + LENGTH).alias("b"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a row with a smaller id, or in the
    same row before. A null text counts as empty and a null id as larger than all others. Rows that share id and text get
    equal results and are no repeats of each other; rows that share an id but not the text count as parts of one document,
    in order of a hash of the text, and no string crosses them. Ids must be integers. Empty tables give empty results.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    if docs.groupBy("doc").count().filter("count > 1").limit(1).count():
        texts = docs.select("doc", F.xxhash64("text").alias("h")).distinct()
        shared = texts.groupBy("doc").agg(F.sort_array(F.collect_list("h")).alias("hs")).filter("size(hs) > 1")
        docs = docs.join(shared, "doc", "left").withColumn("version", F.coalesce(F.array_position("hs", F.xxhash64("text")).cast("int") - 1, F.lit(0))).drop("hs")
    else:
        docs = docs.withColumn("version", F.lit(0))

    def scan(batches):
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                yield _find(batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    found = docs.select("doc", "version", "text").mapInArrow(scan, ANCHOR)
    # settled rows go anywhere; open ones meet by gram
    dealt = found.repartition(F.when(F.col("open"), F.col("g")).otherwise(F.xxhash64("doc", "pos")))
    settled = materialize(dealt.sortWithinPartitions("g", "c", "doc", "pos").mapInArrow(_settle, ANCHOR))
    spans = settled.filter("not open").select("doc", F.col("pos").alias("a"), (F.col("pos") + F.col("reach")).alias("b"))

    def wanted(opened: DataFrame) -> DataFrame:
        return opened.groupBy("doc").agg(F.collect_list(F.struct("g", "pos", "reach")).alias("at"))

    def cut(batches):
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            at = batch.column("at")
            n = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            g, pos, reach = (flat.field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), n)
            version = batch.column("version").to_numpy()
            mine = (pos >> 32) == version[row]
            g, pos, reach, row = g[mine], pos[mine], reach[mine], row[mine]
            begin = offsets[row] + (pos & 0xFFFFFFFF) - reach // 256
            end = offsets[row] + (pos & 0xFFFFFFFF) + GRAM + reach % 256
            raw = buf.tobytes()
            text = [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(batch.column("doc").to_numpy()[row]), pa.array(pos), pa.array(reach), pa.array(text, type=pa.binary())], names=["g", "doc", "pos", "reach", "context"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["g", "doc", "pos"])
        reach = pdf["reach"].to_numpy().astype(np.int64)
        i, a, b = covered(pdf["g"].to_numpy(), pdf["doc"].to_numpy(), pdf["pos"].to_numpy(), reach // 256, reach % 256, pdf["context"].to_list())
        return pd.DataFrame({"doc": pdf["doc"].to_numpy()[i], "a": a, "b": b})

    opened = settled.filter("open")
    tasks = max(1, opened.count() // TASK_ROWS)
    texts = docs.select("doc", "doc_id", "version", "text")

    def contexts(of: DataFrame) -> DataFrame:
        return texts.join(wanted(of), "doc").select("doc", "version", "text", "at").mapInArrow(cut, "g long, doc long, pos long, reach int, context binary")

    hot = materialize(opened.groupBy("g").count().filter(F.col("count") > SORT_ROWS).select("g"))  # at most one gram for SORT_ROWS rows
    if hot.limit(1).count():
        spans = spans.unionByName(_hot_spans(contexts(opened.join(F.broadcast(hot), "g"))))
        opened = opened.join(F.broadcast(hot), "g", "left_anti")
    sorted_spans = contexts(opened).groupBy(F.pmod("g", F.lit(tasks)).alias("task")).applyInPandas(compare, "doc long, a long, b long")
    all_spans = spans.unionByName(sorted_spans).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    kind = docs.schema["doc_id"].dataType.simpleString()

    def drop(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                buf, offsets = bytehash.text_buffer(part.column("text"))
                at = part.column("spans")
                cuts, flat = at.offsets.to_numpy(), at.flatten()
                base = cuts[0]
                a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                version = part.column("version").to_numpy()
                removed, runs, kept = [], [], []
                for r in range(part.num_rows):
                    text = buf[offsets[r] : offsets[r + 1]]
                    x, y = a[cuts[r] - base : cuts[r + 1] - base], b[cuts[r] - base : cuts[r + 1] - base]
                    own = (x >> 32) == version[r]
                    x, y = x[own] & 0xFFFFFFFF, y[own] & 0xFFFFFFFF
                    if not len(x):
                        removed.append(0), runs.append(0), kept.append(text.tobytes())
                        continue
                    step = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(step, x, 1)
                    np.add.at(step, y, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, type=pa.int64()), pa.array(runs, type=pa.int64()), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(all_spans, "doc", "left").select("doc_id", "version", "text", F.coalesce("spans", F.array().cast("array<struct<a: bigint, b: bigint>>")).alias("spans"))
    out = joined.mapInArrow(drop, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc_id", id_col)
