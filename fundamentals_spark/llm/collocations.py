"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Every word that another follows in its piece is a suffix of two or three words. Suffixes are routed to buckets by a hash of their two
leading words, packed by task: equal ones collapse to counts, and runs of equal leading words are stored once. A bucket is sorted
by multikey three-way quicksort to depth three, all its partitions at once: pointers go below, to or above their partition's pivot, the
weight of an equal partition is the count of a phrase, and partitions lighter than the threshold are abandoned. Pairs of
words that hold many of all suffixes are routed by their third word as well; their parts are added up afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundamentals_spark.llm import bytehash
from fundamentals_spark.llm.common import HOT_SHARE, look_up, materialize, text_bytes

#: Bytes of text that one packing step takes.
STEP = 3 << 20
#: Bytes of text whose suffixes one task sorts on average, in so many buckets.
CHUNK = 8 << 20
BUCKETS = 8
#: A pair of words is split if it holds so small a part of all words, and noticed if it holds that of a chunk.
SPLIT, NOTICED = 8192, 16384
#: Parts of a language that are ranked before the language.
SHARES = 64
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_is_word = np.ones(256, dtype=bool)
_is_word[list(_SEPARATORS + b" \t")] = False
_is_separator = np.zeros(256, dtype=bool)
_is_separator[list(_SEPARATORS)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


class Tokens:
    """Words of a chunk of texts: language and word ids (the chunk's own), and the ids of the one or two words behind (0: none, else id + 1)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        langs = langs.fill_null("und").dictionary_encode()
        self.langs = langs.dictionary
        starts, ends, row = bytehash.word_spans(buf, offsets, _is_word)
        cuts = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = np.concatenate([_lower[buf[_is_word[buf]]], np.zeros(1, np.uint8)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
        self.words = words.dictionary
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        piece = np.cumsum(_is_separator[buf])[starts] if len(starts) else starts
        on = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.second, self.third = np.zeros_like(self.word), np.zeros_like(self.word)
        self.second[:-1] = np.where(on, self.word[1:] + 1, 0)
        self.third[:-2] = np.where(on[:-1] & on[1:], self.word[2:] + 1, 0)
        self.first = self.lang * len(self.words) + self.word


def _chunks(batches):
    for batch in batches:
        buf, offsets = bytehash.text_buffer(batch.column("text"))
        for a, b in bytehash.row_chunks(offsets, STEP):
            if offsets[b] > offsets[a]:
                yield Tokens(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column("lang").slice(a, b - a))


def _texts(words: pa.Array) -> pa.Array:
    return words.cast(pa.string())


def _count_words(batches):
    """Counts of a chunk's words, and of the pairs of words that it holds often."""
    for t in _chunks(batches):
        keys, n = np.unique(t.first, return_counts=True)
        pairs = np.flatnonzero(t.second)
        twins, m = np.unique(t.first[pairs] * (len(t.words) + 1) + t.second[pairs], return_counts=True)
        often = m * NOTICED >= len(t.word)
        twins, m = twins[often], m[often]
        first = np.concatenate([keys, twins // (len(t.words) + 1)])
        second = pa.array(np.concatenate([np.zeros(len(keys), np.int64), twins % (len(t.words) + 1)]) - 1)
        second = pc.if_else(pc.less(second, 0), pa.scalar(None, pa.int64()), second)
        cols = [t.langs.take(pa.array(first // len(t.words))), _texts(t.words.take(pa.array(first % len(t.words)))), _texts(t.words.take(second)), pa.array(np.concatenate([n, m]))]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "w1", "w2", "n"])


def _hashes(words: pa.Array) -> np.ndarray:
    buf, offsets = bytehash.text_buffer(words)
    prefix = bytehash.prefix_hash(buf)
    return bytehash.mix(bytehash.substring_hash(prefix, offsets[:-1], offsets[1:]) + (offsets[1:] - offsets[:-1]).astype(np.uint64))


def _packed(words: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """For each slice of ``ids`` its words, each closed by a space, as one value."""
    taken = words.take(pa.array(ids))
    sizes = pc.binary_length(taken).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(at.astype(np.int64)), taken.buffers()[2]])


def _numbers(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64) * 4), pa.py_buffer(np.ascontiguousarray(values, dtype=np.int32))])


def _pack(buckets: int, hot: list[tuple[str, str, str]]):
    """Rows of (bucket, lang): first words with the number of pairs of each, second words with the number of suffixes of each, third words with counts."""

    def run(batches):
        for t in _chunks(batches):
            size = len(t.words) + 1
            have = np.flatnonzero(t.second)
            pair, third = t.first[have] * size + t.second[have], t.third[have]
            order = np.lexsort((third, pair))
            pair, third = pair[order], third[order]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]) if len(pair) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate([at, [len(pair)]]))
            pair, third = pair[at], third[at]
            first, second = pair // size, pair % size - 1
            by_word, by_lang = _hashes(t.words), _hashes(t.langs.cast(pa.large_binary()))
            route = bytehash.mix(by_word[first % len(t.words)] + np.uint64(3) * by_lang[first // len(t.words)]) + by_word[second]
            split = np.isin(pair, _places(t, hot))
            route = np.where(split & (third > 0), bytehash.mix(route) + by_word[third - 1], route)
            bucket = (bytehash.mix(route) % np.uint64(buckets)).astype(np.int64)
            lang = first // max(len(t.words), 1)
            order = np.lexsort((lang, bucket))
            bucket, lang, pair, first, second, third, n = (x[order] for x in (bucket, lang, pair, first, second, third, n))
            edge = lambda x: np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
            group = edge(bucket) | edge(lang)
            second_run, first_run = group | edge(pair), group | edge(first)
            g, two, one = np.flatnonzero(group), np.flatnonzero(second_run), np.flatnonzero(first_run)
            if not len(g):
                continue
            ends = lambda x, top: np.concatenate([x, [top]])
            closed = pc.binary_join_element_wise(pa.concat_arrays([t.words, pa.array([b""], pa.large_binary())]), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
            g1, g2, g3 = ends(np.searchsorted(one, g), len(one)), ends(np.searchsorted(two, g), len(two)), ends(g, len(n))
            cols = [
                pa.array(bucket[g]), t.langs.take(pa.array(lang[g])),
                _packed(closed, first[one] % len(t.words), g1), _numbers(np.diff(ends(np.searchsorted(two, one), len(two))), g1),
                _packed(closed, second[two], g2), _numbers(np.diff(ends(two, len(n))), g2),
                _packed(closed, np.where(third > 0, third - 1, len(t.words)), g3), _numbers(n, g3),
            ]
            yield from pa.Table.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in cols], names=_PACKED).to_batches()

    return run


_PACKED = ["bucket", "lang", "w1", "n1", "w2", "n2", "w3", "n3"]


def _places(t: Tokens, hot: list[tuple[str, str, str]]) -> np.ndarray:
    """Codes of the pairs ``hot`` in a chunk."""
    if not hot:
        return np.zeros(0, np.int64)
    find = lambda values, among: pc.index_in(pa.array([v.encode() for v in values], among.type), value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lang, a, b = find([h[0] for h in hot], t.langs.cast(pa.large_binary())), find([h[1] for h in hot], t.words), find([h[2] for h in hot], t.words)
    ok = (lang >= 0) & (a >= 0) & (b >= 0)
    return (lang[ok] * len(t.words) + a[ok]) * (len(t.words) + 1) + b[ok] + 1


def multikey_counts(keys: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Equal partitions of a multikey three-way quicksort: (depth from 1, a row of each, weight of each), those of at least ``least``.

    ``keys`` has a row for each suffix and a column for each depth; 0 ends a suffix. All partitions of a round are split at once: each
    pointer is compared with the pivot of its partition at that partition's depth. Lighter partitions are abandoned.
    """
    rows, depth = np.flatnonzero(keys[:, 0]), np.zeros(1, np.int64)
    group, found = np.zeros(len(rows), np.int64), []
    while len(rows):
        size = np.bincount(group, minlength=len(depth))
        start = np.cumsum(size) - size
        symbol = keys[rows, depth[group]]
        pivot = symbol[start + size // 2][group]
        parts = []
        for part, step in ((symbol < pivot, 0), (symbol == pivot, 1), (symbol > pivot, 0)):
            r, g = rows[part], group[part]
            heavy = np.bincount(g, weights=weight[r], minlength=len(depth)) >= least
            keep = heavy[g]
            r, g = r[keep], g[keep]
            d = depth + step
            if step and len(r):
                edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                total = np.add.reduceat(weight[r], edge)
                for k in np.unique(d[g[edge]]):
                    of = d[g[edge]] == k
                    found.append((int(k), r[edge[of]], total[of]))
                on = d[g] < keys.shape[1]
                r, g = r[on], g[on]
                on = keys[r, d[g]] > 0
                r, g = r[on], g[on]
            if len(r):
                new = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
                parts.append((r, new, d[g[np.concatenate([[True], g[1:] != g[:-1]])]]))
        shift = np.cumsum([0] + [len(p[2]) for p in parts])
        rows = np.concatenate([p[0] for p in parts]) if parts else rows[:0]
        group = np.concatenate([p[1] + s for p, s in zip(parts, shift)]) if parts else rows
        depth = np.concatenate([p[2] for p in parts]) if parts else depth[:0]
    return found


def _opened(cells: list[bytes]) -> pa.Array:
    """Words of packed values, in order."""
    buf = np.frombuffer(b"".join(cells), dtype=np.uint8)
    stop = np.flatnonzero(buf == 32)
    cuts = np.concatenate([[0], stop - np.arange(len(stop))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.concatenate([buf[buf != 32], np.zeros(1, np.uint8)]))])


def _phrases(lang: str, cells: list[list[bytes]], least: int, hot: list[tuple[str, str, str]]) -> pa.RecordBatch:
    w1, w2, w3 = (_opened([c[k] for c in cells]) for k in (0, 2, 4))
    n1, n2, n = (np.frombuffer(b"".join(c[k] for c in cells), dtype=np.int32).astype(np.int64) for k in (1, 3, 5))
    words = pa.concat_arrays([w1, w2, w3]).dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    names = words.dictionary
    none = pc.index(names, pa.scalar(b"", pa.large_binary())).as_py()
    ids[ids == none + 1] = 0
    a, b, c = ids[: len(w1)], ids[len(w1) : len(w1) + len(w2)], ids[len(w1) + len(w2) :]
    keys = np.stack([np.repeat(np.repeat(a, n1), n2), np.repeat(b, n2), c], axis=1)
    out = [(d, keys[r], m) for d, r, m in multikey_counts(keys, n, least) if d > 1]
    mine = [(x, y) for l, x, y in hot if l == lang]
    if mine:  # parts of a split pair count whatever they hold
        find = lambda k: pc.index_in(pa.array([m[k].encode() for m in mine], pa.large_binary()), value_set=names).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        top = len(names) + 2
        codes = find(0) * top + find(1)
        code = keys[:, 0] * top + keys[:, 1]
        out = [(d, k[~s], m[~s]) for d, k, m, s in ((d, k, m, np.isin(k[:, 0] * top + k[:, 1], codes) & (d == 2)) for d, k, m in out)]
        inside = np.flatnonzero(np.isin(code, codes))
        got, first, back = np.unique(code[inside], return_index=True, return_inverse=True)
        out.append((2, keys[inside[first]], np.bincount(back, weights=n[inside], minlength=len(got)).astype(np.int64)))
    k = np.concatenate([x[1] for x in out]) if out else np.zeros((0, 3), np.int64)
    two = np.concatenate([np.full(len(x[2]), x[0] == 2) for x in out]) if out else np.zeros(0, bool)
    take = lambda x: _texts(names.take(pa.array(x - 1, mask=x < 1)))
    count = np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), take(k[:, 0]), take(k[:, 1]), take(np.where(two, 0, k[:, 2])), pa.array(count.astype(np.int64))], names=["lang", "w1", "w2", "w3", "n"])


def _sort_buckets(least: int, hot: list[tuple[str, str, str]]):
    def run(batches):
        now, cells = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _PACKED)):
                if row[:2] != now:
                    if cells:
                        yield _phrases(now[1], cells, least, hot)
                    now, cells = row[:2], []
                cells.append(row[2:])
        if cells:
            yield _phrases(now[1], cells, least, hot)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, size 1 to 3, f) and words of each language (lang, n)."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counted = materialize(texts.mapInArrow(_count_words, "lang string, w1 string, w2 string, n long").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")))
    totals = counted.filter("w2 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [(r["lang"], r["w1"], r["w2"]) for r in counted.filter((F.col("w2").isNotNull()) & (F.col("n") * SPLIT >= total)).collect()]  # at most SPLIT pairs
    _, size = text_bytes(texts, "text")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK))
    packed = texts.mapInArrow(_pack(BUCKETS * tasks, hot), "bucket long, lang string, w1 binary, n1 binary, w2 binary, n2 binary, w3 binary, n3 binary")
    sorted_ = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_sort_buckets(least, hot), "lang string, w1 string, w2 string, w3 string, n long")
    longer = sorted_.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))
    every = counted.filter("w2 is null").withColumn("w3", F.lit(None).cast("string")).select("lang", "w1", "w2", "w3", "n").union(longer).filter(F.col("n") >= least)
    frequent = every.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.expr("1 + int(w2 is not null) + int(w3 is not null)").alias("size"), F.col("n").alias("f"))
    return materialize(frequent), totals


def _words(first: int, count: int) -> Column:
    return F.expr(f"array_join(slice(split(phrase, ' '), {first}, {count}), ' ')")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words.

    a, l and r count the phrase and both parts of its weakest cut, score is floor(10**6 a a / (l r)) in exact decimals, n counts
    the language's words. A phrase within a longer candidate that holds ``share`` percent of its occurrences is dropped.
    A null text is empty, a null language reads ``und``; repeated rows count as often as they stand there; other columns are not
    read; an empty table gives an empty one.
    """
    frequent, totals = phrase_counts(docs, text_col, lang_col, least)
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    candidates = frequent.filter("size > 1").withColumnRenamed("f", "a")
    cut = lambda k, side, words: F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), words.alias("part"))
    pairs = F.array(cut(1, "l", _words(1, 1)), cut(1, "r", _words(2, 2)), cut(2, "l", _words(1, 2)), cut(2, "r", _words(3, 1)))
    parts = candidates.select("lang", "phrase", "size", "a", F.explode(F.when(F.col("size") == 2, F.slice(pairs, 1, 2)).otherwise(pairs)).alias("x")).select("lang", "phrase", "size", "a", "x.*")
    # a part of f occurrences has at most f / least candidates of a size and side, so words / HOT_SHARE occurrences make it hot
    known = frequent.select("lang", F.col("phrase").alias("part"), "f")
    parts = look_up(parts, known, ["lang", "part"], ["f"], "f", words, F.struct("phrase", "cut", "side"))
    of = lambda k, side: F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("f")))
    scored = parts.groupBy("lang", "phrase", "size", "a").agg(of(1, "l").alias("l1"), of(1, "r").alias("r1"), of(2, "l").alias("l2"), of(2, "r").alias("r2"))
    exact = lambda k: F.expr(f"(cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(exact(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2)]
    scored = scored.select("lang", "phrase", "size", "a", F.array_min(F.array_compact(F.array(*cuts))).alias("c"))
    longer = candidates.filter("size = 3").select("lang", F.explode(F.array(_words(1, 2), _words(2, 2))).alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    alone = scored.join(longer, ["lang", "phrase"], "left").filter((F.col("size") == 3) | F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    # a phrase must be among the first of its share of the language before it meets all others
    order = (F.desc("c.score"), F.desc("a"), "phrase")
    first = alone.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("at", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("at") <= top)
    ranked = first.select("lang", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
