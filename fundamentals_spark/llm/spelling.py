"""Spelling variants: the vocabulary acceptor, a one-edit transducer and the acceptor again are composed.

The composed machine reads one word on its left tape and a word at distance one on its right tape. Its transducer copies
symbols, makes one edit (replace; or delete, where the right tape may not go on with the deleted symbol) and copies the
rest, so it accepts each pair by one path only: the edit stands where the words first differ. Initial states of the machine
are prefixes. A prefix with few words is one partition, whose acceptor is built, minimised and composed in one task. A
prefix with many words gives its subtrees to longer prefixes and keeps the edits at its own end; as the words of such a pair agree
in all that follows the edit, these are dealt out by the hash of what follows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import discard, materialize

#: Runs of letters; only A-Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of one partition of the composed machine.
LEAF = 50_000
#: Hot prefixes are broadcast up to this number (of at most 64 symbols each), and joined by key beyond it.
BROADCAST_PREFIXES = 200_000
#: Symbols that one round of the search for hot prefixes looks further.
DEPTH = 16
#: Composed states that one step expands.
STEP = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 3, shortest: int = 5, damage: int = 97) -> DataFrame:
    """word and n (long) of all words with ``shortest`` code points and ``least`` occurrences.

    Of a run whose h = crc32("<id>:<run>") ``damage`` divides, the code point at h % length is deleted first. A null text
    has no words, a null id reads as empty; repeated rows count as often as they stand there; other columns are not read.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("w"))
    runs = runs.select("id", F.when(F.col("w").rlike("[A-Z]"), F.translate("w", _UPPER, _LOWER)).otherwise(F.col("w")).alias("w"))
    runs = runs.filter(F.length("w") >= shortest).select("w", F.crc32(F.concat_ws(":", "id", "w").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(w, 1, cast(h % length(w) as int)), substring(w, cast(h % length(w) as int) + 2))")
    words = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """Minimal deterministic acceptor of sorted, distinct words; the path of a word adds up to its place among them.

    ``arcs`` of a state lie together, by symbol. ``skip`` counts the words that stand before those through an arc, and
    ``mark`` has bits for the lengths and the symbols that may follow a state: where two states share no bit of either
    half, no word follows both.
    """

    def __init__(self, words: list[str], symbols: dict[str, int]):
        ids: dict[tuple, int] = {}
        count, mark, keys = [], [], []

        def close(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, *arcs)
            got = ids.get(key)
            if got is None:
                got = ids[key] = len(keys)
                keys.append(key)
                length, shape = (1, 1) if final else (0, 0)
                for symbol, target in arcs:
                    l, s = mark[target]
                    length |= (l << 1 | l >> 31) & 0xFFFFFFFF
                    by = symbol * 7 % 31 + 1
                    shape |= (s << by | s >> (32 - by)) & 0xFFFFFFFF
                count.append(final + sum(count[t] for _, t in arcs))
                mark.append((length, shape))
            return got

        finals, arcs, before = [False], [[]], []
        for word in words:
            w = [symbols[c] for c in word]
            same = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                same += 1
            for d in range(len(before), same, -1):
                arcs[d - 1].append((before[d - 1], close(finals.pop(), arcs.pop())))
            for _ in range(len(w) - same):
                finals.append(False)
                arcs.append([])
            finals[-1], before = True, w
        for d in range(len(before), 0, -1):
            arcs[d - 1].append((before[d - 1], close(finals.pop(), arcs.pop())))
        self.start = close(finals[0], arcs[0])
        self.final = np.array([k[0] for k in keys], dtype=bool)
        self.degree = np.array([len(k) - 1 for k in keys], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.degree)])[:-1]
        flat = [(s, a, t, q) for q, k in enumerate(keys) for s, (a, t) in enumerate(k[1:])]
        self.label = np.array([x[1] for x in flat], dtype=np.int64)
        self.target = np.array([x[2] for x in flat], dtype=np.int64)
        held = np.array(count, dtype=np.int64)[self.target] if flat else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(held)])
        of = np.array([x[3] for x in flat], dtype=np.int64)
        self.skip = total[:-1] - total[self.first[of]] + self.final[of] if flat else held
        self.by = np.full((len(keys), len(symbols)), -1, dtype=np.int32)
        self.by[of, self.label] = np.arange(len(flat))
        self.length = np.array([m[0] for m in mark], dtype=np.int64)
        self.shape = np.array([m[1] for m in mark], dtype=np.int64)

    def leave(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every state in turn its arcs: the row of the state, the arc."""
        d = self.degree[q]
        row = np.repeat(np.arange(len(q)), d)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(d) - d, d) + self.first[q][row]


def _edited(left: Acceptor, right: Acceptor, todo: list[tuple], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Copy the rest on both tapes from states (q1, q2, place 1, place 2, symbol the right tape may not take next or -1) behind the edit."""
    while todo:
        q1, q2, i1, i2, no = todo.pop()
        live = ((left.length[q1] & right.length[q2]) != 0) & ((left.shape[q1] & right.shape[q2]) != 0)
        q1, q2, i1, i2, no = q1[live], q2[live], i1[live], i2[live], no[live]
        if len(q1) > STEP:
            todo += [(q1[a : a + STEP], q2[a : a + STEP], i1[a : a + STEP], i2[a : a + STEP], no[a : a + STEP]) for a in range(0, len(q1), STEP)]
            continue
        if not len(q1):
            continue
        ends = left.final[q1] & right.final[q2]
        if ends.any():
            out.append((i1[ends], i2[ends]))
        row, arc = left.leave(q1)
        other = right.by[q2[row], left.label[arc]]
        go = (other >= 0) & (left.label[arc] != no[row])
        row, arc, other = row[go], arc[go], other[go]
        todo.append((left.target[arc], right.target[other], i1[row] + left.skip[arc], i2[row] + right.skip[other], np.full(len(row), -1)))


def _edits(acceptor: Acceptor, q: np.ndarray, i: np.ndarray) -> list[tuple]:
    """States behind an edit at ``q``, within one acceptor: replace by a later symbol, and delete."""
    row, arc = acceptor.leave(q)
    later = acceptor.first[q][row] + acceptor.degree[q][row] - 1 - arc
    pair = np.repeat(np.arange(len(row)), later)
    second = arc[pair] + 1 + np.arange(len(pair)) - np.repeat(np.cumsum(later) - later, later)
    first, base = arc[pair], i[row][pair]
    replace = (acceptor.target[first], acceptor.target[second], base + acceptor.skip[first], base + acceptor.skip[second], np.full(len(pair), -1))
    delete = (acceptor.target[arc], q[row], i[row] + acceptor.skip[arc], i[row], acceptor.label[arc])
    return [replace, delete]


def compose(words: list[str], symbols: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of ``words`` (sorted, distinct) that differ by one edit, each pair once."""
    acceptor, out = Acceptor(words, symbols), []
    todo = [(np.array([acceptor.start]), np.array([0]))]
    while todo:
        q, i = todo.pop()
        if len(q) > STEP // 16:
            todo += [(q[a : a + STEP // 16], i[a : a + STEP // 16]) for a in range(0, len(q), STEP // 16)]
            continue
        _edited(acceptor, acceptor, _edits(acceptor, q, i), out)
        row, arc = acceptor.leave(q)
        if len(arc):
            todo.append((acceptor.target[arc], i[row] + acceptor.skip[arc]))
    return _both(out)


def compose_first(cut: list[str], kept: list[str], symbols: dict[str, int]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The same with the edit at the first symbol: pairs within ``cut`` by replacing it, pairs of ``cut`` and ``kept`` by deleting it in the former."""
    left, replaced, deleted = Acceptor(cut, symbols), [], []
    states = _edits(left, np.array([left.start]), np.array([0]))
    _edited(left, left, [states[0]], replaced)
    if kept:
        right = Acceptor(kept, symbols)
        q1, _, i1, _, no = states[1]
        _edited(left, right, [(q1, np.full(len(q1), right.start), i1, np.zeros(len(q1), dtype=np.int64), no)], deleted)
    return _both(replaced), _both(deleted)


def _both(out: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64) for k in (0, 1))


def _partition(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one partition, folded by word: n_near, and the n and spelling of the best near word."""
    pdf = pdf.sort_values(["role", "word"], kind="stable")
    at = int(pdf["at"].iloc[0])
    words, n = pdf["word"].tolist(), pdf["n"].to_numpy()
    rest = [w[at:] for w in words]
    symbols = {c: k for k, c in enumerate(sorted(set("".join(rest))))}
    if pdf["role"].iloc[0] == "leaf":
        a, b = compose(rest, symbols)
    else:
        m = int((pdf["role"] == "cut").sum())
        (a, b), (c, d) = compose_first(rest[:m], rest[m:], symbols)
        a, b = np.concatenate([a, c]), np.concatenate([b, d + m])
    mine, near = np.concatenate([a, b]), np.concatenate([b, a])
    names = np.array(words, dtype=object)
    order = np.lexsort((pd.Series(words).rank(method="dense").to_numpy(), -n))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(words), len(words))
    np.minimum.at(best, mine, rank[near])
    count = np.bincount(mine, minlength=len(words))
    have = np.flatnonzero(count)
    top = order[best[have]]
    return pd.DataFrame({"word": names[have], "n_near": count[have], "best_n": n[top], "best": names[top]})


def _hot_prefixes(words: DataFrame, leaf: int) -> DataFrame:
    """p and held: prefixes of more than ``leaf`` words; a round looks ``DEPTH`` symbols further below those that reach its end."""
    found, under, low = [], words.select("word"), 0
    while True:
        high = low + DEPTH - 1
        prefixes = under.select(F.explode(F.expr(f"transform(sequence({low}, least(length(word), {high})), d -> substring(word, 1, d))")).alias("p"))
        found.append(materialize(prefixes.groupBy("p").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > leaf)))
        deepest = found[-1].filter(F.length("p") == high).select(F.col("p").alias("top"))
        if deepest.limit(1).count() == 0:
            return reduce(DataFrame.union, found)
        low = high + 1
        under = under.filter(F.length("word") >= low).join(deepest, F.expr(f"substring(word, 1, {high})") == F.col("top"), "left_semi")


def _partitions(words: DataFrame, leaf: int) -> DataFrame:
    """Rows (key, bucket, role, at, word, n): the words of each initial state's partition."""
    hot = _hot_prefixes(words, leaf)
    size = hot.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.length("p")), F.lit(-1)).alias("longest")).first()
    known = F.broadcast if size["rows"] <= BROADCAST_PREFIXES and size["longest"] <= 64 else (lambda df: df)
    prefixes = words.select("word", "n", F.explode(F.expr(f"sequence(0, least(length(word), {size['longest'] + 1}))")).alias("at")).withColumn("p", F.expr("substring(word, 1, at)"))
    own, parent = hot.select("p", "held"), hot.select(F.col("p").alias("up"), F.lit(True).alias("under"))
    marked = prefixes.join(known(own), "p", "left").withColumn("up", F.when(F.col("held").isNull() & (F.col("at") > 0), F.expr("substring(word, 1, at - 1)"))).join(known(parent), "up", "left")
    marked = marked.filter("held is not null or under or at = 0")
    bucket = F.expr(f"cast(pmod(xxhash64(x.rest), ceil(2 * held / {leaf})) as int)")
    roles = F.when(F.col("held").isNull(), F.array(F.struct(F.lit("leaf").alias("role"), F.lit("").alias("rest")))).otherwise(
        F.array_compact(F.array(F.when(F.expr("at < length(word)"), F.struct(F.lit("cut").alias("role"), F.expr("substring(word, at + 2)").alias("rest"))), F.struct(F.lit("kept").alias("role"), F.expr("substring(word, at + 1)").alias("rest"))))
    )
    rows = marked.withColumn("x", F.explode(roles))
    return rows.select(F.col("p").alias("key"), F.coalesce(bucket, F.lit(-1)).alias("bucket"), F.col("x.role").alias("role"), F.col("at").cast("int").alias("at"), "word", "n")


def spelling_variants(words: DataFrame, leaf: int = LEAF, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; each word once).

    Two words are near if one inserted, deleted or replaced code point makes them equal. ``form`` is the near word of
    largest n (ties: smallest in code-point order) if that n is at least ``factor`` times the word's, else null; ``root``
    follows forms to the last. As n doubles with each form, at most six rounds of pointer doubling find every root.
    A word has a bounded number of near words, so no key is hot; an empty table gives an empty one.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    found = _partitions(words, leaf).groupBy("key", "bucket").applyInPandas(_partition, "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("best_n"), "best")).alias("top"))
    fits = F.col("top").isNotNull() & (-F.col("top.best_n") >= factor * F.col("n"))
    out = words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("top.best_n")).alias("form_n")
    )
    out = materialize(out)
    steps = materialize(out.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(steps)
        steps = moved
        if steps.filter("moved").limit(1).count() == 0:
            break
    return out.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
