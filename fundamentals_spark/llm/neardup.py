"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification of shingle sets.

A forest has trees; a document stands in a tree under its label, a sequence of DEPTH minimum hashes. Documents that share
the shortest prefix of the forest in some tree meet in that tree's subtrie. There the labels are sorted, and matching
starts at full depth: documents under one prefix are compared by their sketches (one byte of every minimum hash) and
joined; the prefix is then shortened level by level, as long as it covers documents that are not yet joined, down to
the depth at which a pair at the threshold meets in some tree with the target recall.

What is joined makes candidate groups, inside which all pairs are compared exactly on shingle sets, in blocks of bounded
size. Sets are of 64-bit shingle hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm import bytehash
from fundamentals_spark.llm.common import discard, materialize
from fundamentals_spark.llm.components import components

N, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999995
#: Documents of a comparison block; a group with more is compared block by block.
BLOCK = 1024
#: A pair's sketches agree in at least this share of their bytes, which a pair at the threshold misses with a chance under one in a million.
SKETCH_SHARE = 0.65
#: 64-bit words of the filter that tells candidate nodes in the tasks; at most so many rows reach the driver.
FILTER_WORDS = 1 << 20
CHUNK = 1 << 20
_SPACES = bytehash.spaces_table()
_COMBINE = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(64)], dtype=np.uint64)


def prefix_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair of this similarity meets in some tree with chance ``recall``; shortened from ``depth``."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of n consecutive words of each row, sorted in it, and where each row begins.

    A row with fewer words has one shingle of all its words; a row without words has none.
    """
    starts, ends, rows = bytehash.word_spans(buf, offsets, _SPACES)
    h = bytehash.mix(bytehash.substring_hash(bytehash.prefix_hash(buf), starts, ends))
    size = len(offsets) - 1
    count = np.bincount(rows, minlength=size)
    parts_h, parts_r = [], []
    if len(h) >= n:
        whole = rows[: len(h) - n + 1] == rows[n - 1 :]
        s = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for i in range(n):
            s += h[i : len(h) - n + 1 + i] * _COMBINE[i + 1]
        parts_h.append(bytehash.mix(s[whole]))
        parts_r.append(rows[: len(h) - n + 1][whole])
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        parts_h.append(bytehash.mix(np.array([sum(int(h[first[r] + i]) * int(_COMBINE[i + 1]) for i in range(count[r])) % 2**64 for r in short], dtype=np.uint64)))
        parts_r.append(short)
    if not parts_h:
        return np.zeros(0, dtype=np.uint64), np.zeros(size + 1, dtype=np.int64)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(size + 1))


_SEEDS = np.random.default_rng(11).integers(1, 2**63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def forest_labels(h: np.ndarray, first: np.ndarray, trees: int, depth: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows that have shingles: rows x trees hashes of the shortest prefixes, and rows x (trees * depth) bytes, one of each minimum hash."""
    out = np.zeros((len(first), trees), dtype=np.uint64)
    sketch = np.zeros((len(first), trees * depth), dtype=np.uint8)
    for t in range(trees):
        for d in range(depth):
            k = t * depth + d
            low = np.minimum.reduceat((h * _SEEDS[0, k] + _SEEDS[1, k]) >> np.uint64(16), first)
            sketch[:, k] = (bytehash.mix(low) & np.uint64(255)).astype(np.uint8)
            if d < shortest:
                out[:, t] += low * _COMBINE[d + 1]
    return bytehash.mix(out + np.arange(1, trees + 1, dtype=np.uint64)), sketch


def trie_groups(sketch: np.ndarray, tree: int, depth: int, shortest: int, least: int) -> np.ndarray:
    """Root (smallest index of its group) of every row of one subtrie, after matching from full depth to the shortest prefix.

    Two rows are joined if at least ``least`` bytes of their sketches agree; rows already joined are not compared, and
    a prefix is no longer shortened once one group is left.
    """
    m = len(sketch)
    label = sketch[:, tree * depth : (tree + 1) * depth]
    order = np.lexsort(label.T[::-1])
    step = label[order[1:]] != label[order[:-1]]
    common = np.where(step.any(axis=1), step.argmax(axis=1), depth)  # with the row before, in sorted order
    group = np.arange(m)
    for d in range(depth, shortest - 1, -1):
        cuts = np.flatnonzero(common < d) + 1 if d > shortest else np.zeros(0, dtype=np.int64)  # the whole subtrie shares the shortest prefix
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [m]])):
            run = order[lo:hi]
            for x in run:
                others = run[group[run] != group[x]]
                if not len(others):
                    if (group[run] == group[x]).all():
                        break
                    continue
                near = others[(sketch[others] == sketch[x]).sum(axis=1) >= least]
                if len(near):
                    group[np.isin(group, group[near])] = group[x]
        if (group == group[0]).all():
            break
    _, at, back = np.unique(group, return_index=True, return_inverse=True)
    return at[back]


def _text_scan(df: DataFrame, handle, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                yield handle(batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    return df.mapInArrow(run, schema)


def _set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each row's shingle set, for rows that have shingles."""
    if not len(first):
        return np.zeros((2, 0), dtype=np.uint64)
    return np.stack([np.add.reduceat(bytehash.mix(h), first), np.add.reduceat(bytehash.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = N, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """id_col, class_id and n_links for every row.

    Two rows are linked if the Jaccard similarity of their sets of n-word shingles is at least ``similarity``; n_links
    counts a row's links, class_id is the smallest id among the rows joined by links. A text with fewer than n words has
    one shingle of all of them; a null text or one without words has none and no links. Repeated rows are linked with each
    other. A row with a null id takes part and is never a class's name unless its class has no other id. Empty tables give
    empty results; other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shortest = prefix_depth(similarity, trees, depth, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batch, buf, offsets):
        h, at = shingles(buf, offsets, n)
        has = np.flatnonzero(np.diff(at))
        keys = np.zeros((2, batch.num_rows), dtype=np.uint64)
        keys[:, has] = _set_keys(h, at[has])
        table, sketch = forest_labels(h, at[has], trees, depth, shortest) if len(has) else (np.zeros((0, trees), dtype=np.uint64), np.zeros((0, trees * depth), dtype=np.uint8))
        some = np.diff(at) > 0
        forest = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * trees)]).astype(np.int32), pa.array(table.ravel().view(np.int64)))
        sketches = iter(sketch)
        blobs = pa.array([next(sketches).tobytes() if x else None for x in some], type=pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(k.view(np.int64)) for k in keys), forest, blobs], names=["doc_id", "k1", "k2", "forest", "sketch"])

    # rows with one shingle set are one node, named by two keys of the set; copies need no comparison
    rows = materialize(_text_scan(docs, sign, f"doc_id {kind}, k1 long, k2 long, forest array<long>, sketch binary"))
    nodes = rows.filter("sketch is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("forest").alias("forest"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes)

    edges = _met(nodes, trees, depth, shortest, similarity)
    candidate = components(edges)
    candidate = materialize(nodes.select("k1", "k2", "copies").join(candidate.select(F.col("id").alias("k1"), "comp"), "k1"))
    links = _verified(docs, candidate, similarity, n)
    discard(candidate)

    # classes: what the links join, named by the smallest id
    node = lambda a, b: F.xxhash64(a, b)
    joined = components(links.select(node("k1", "k2").alias("a"), node("r1", "r2").alias("b"))).withColumnRenamed("id", "node")
    counts = links.groupBy("k1", "k2").agg(F.sum("links").alias("links")).withColumn("node", node("k1", "k2"))
    named = nodes.select("k1", "k2", "copies", "least").join(counts.join(joined, "node").drop("node"), ["k1", "k2"], "left").filter("copies > 1 or links > 0")
    named = named.withColumn("comp", F.coalesce("comp", node("k1", "k2")))
    names = named.groupBy("comp").agg(F.min("least").alias("class_id"))
    result = named.join(names, "comp").select("k1", "k2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "k1", "k2").join(result, ["k1", "k2"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _in_blocks(members: DataFrame, group: str, size: str, spread: int) -> DataFrame:
    """``members`` with g, i, j and b: groups of at most BLOCK rows share tasks (j = -1); larger ones are cut into blocks b, and every pair of blocks is a task's."""
    plan = members.withColumn("blocks", F.ceil(F.col(size) / BLOCK).cast("int"))
    plan = plan.withColumn("b", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
    one = F.struct(F.pmod(F.xxhash64(group), F.lit(spread)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    many = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col(group).alias("g"), F.least("b", x).alias("i"), F.greatest("b", x).alias("j")))
    plan = plan.withColumn("to", F.explode(F.when(F.col("blocks") == 1, F.array(one)).otherwise(many)))
    return plan.select("*", "to.*").drop("to", "blocks")


def _met(nodes: DataFrame, trees: int, depth: int, shortest: int, similarity: float) -> DataFrame:
    """(a, b) keys k1 of nodes that the forest joins: a node and the first of its group in a subtrie."""
    places = nodes.select("k1", F.posexplode("forest").alias("tree", "prefix"))
    subtries = places.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = places.join(subtries, "prefix")
    met = materialize(met.join(nodes.select("k1", "sketch"), "k1"))
    share = min(SKETCH_SHARE, similarity * SKETCH_SHARE / SIMILARITY)
    least = int(np.ceil(share * trees * depth))

    def match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("prefix", kind="stable")
        sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(len(pdf), trees * depth)
        k1, tree, prefix = (pdf[c].to_numpy() for c in ("k1", "tree", "prefix"))
        cuts = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(pdf)]])
        pairs = cuts[:-1][np.diff(cuts) == 2]  # subtries of two at once
        near = pairs[(sketch[pairs] == sketch[pairs + 1]).sum(axis=1) >= least]
        a, b = [k1[near]], [k1[near + 1]]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 2:
                root = trie_groups(sketch[lo:hi], int(tree[lo]), depth, shortest, least)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                a.append(k1[lo + moved])
                b.append(k1[lo + root[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    sent = _in_blocks(met, "prefix", "size", max(8, met.count() // 2000)).select("g", "i", "j", "k1", "tree", "prefix", "sketch")
    edges = materialize(sent.groupBy("g", "i", "j").applyInPandas(match, "a long, b long").distinct())
    discard(met)
    return edges


def _node_filter(candidate: DataFrame) -> tuple[int, np.ndarray]:
    """Words and bits of a filter that holds every k1 of ``candidate``: aggregated on Spark, at most FILTER_WORDS numbers; false hits only cost time."""
    words = 1 << 10
    while words < FILTER_WORDS and words * 8 < candidate.count():
        words *= 2
    bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k1, {shift}) & 63 as int))")
    rows = candidate.groupBy(F.pmod("k1", F.lit(words)).cast("int").alias("w")).agg(F.bit_or(bit(24).bitwiseOR(bit(34))).alias("bits")).toPandas()
    bits = np.zeros(words, dtype=np.uint64)
    bits[rows["w"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return words, bits


def _verified(docs: DataFrame, candidate: DataFrame, similarity: float, n: int) -> DataFrame:
    """(k1, k2, r1, r2, links) of candidate nodes: linked copies in one comparison block, and the smallest node that the block's links join it with."""
    words, bits = _node_filter(candidate)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches):
        sent: set[tuple[int, int]] = set()  # a task sends a set once, however many copies it holds
        for batch in batches:
            buf_all, offsets_all = bytehash.text_buffer(batch.column("text"))
            for lo, hi in bytehash.row_chunks(offsets_all, CHUNK):
                h, at = shingles(buf_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo], n)
                has = np.flatnonzero(np.diff(at))
                keys = _set_keys(h, at[has])
                mask = (np.uint64(1) << ((keys[0] >> np.uint64(24)) & np.uint64(63))) | (np.uint64(1) << ((keys[0] >> np.uint64(34)) & np.uint64(63)))
                hit = np.flatnonzero((wanted.value[(keys[0] & np.uint64(words - 1)).astype(np.int64)] & mask) == mask)
                new = []
                for x in hit:
                    key = (int(keys[0, x]), int(keys[1, x]))
                    if key not in sent:
                        sent.add(key)
                        new.append(x)
                keys = keys[:, new].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array([h[at[r] : at[r + 1]].tobytes() for r in has[new]], type=pa.binary())], names=["t1", "t2", "shingles"])

    texts = docs.select("text").mapInArrow(sets, "t1 long, t2 long, shingles binary")
    sizes = candidate.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    plan = candidate.join(sizes, "comp")
    sent = texts.join(plan, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    sent = _in_blocks(sent, "comp", "size", max(1, candidate.count() // 500)).select("g", "i", "j", "comp", "k1", "k2", "copies", "b", "shingles")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.drop_duplicates(["k1", "k2"])
        for _, part in pdf.groupby("comp", sort=False) if key[1] < 0 else [(None, pdf)]:
            if len(part) > 1:
                linked = linked_pairs([np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]], similarity)
                if key[1] != key[2]:  # two blocks: pairs inside one are another group's
                    b = part["b"].to_numpy()
                    linked &= b[:, None] != b[None, :]
                links = linked @ part["copies"].to_numpy()
                root = roots(linked)
                some = np.flatnonzero(linked.any(axis=1))
                k1, k2 = part["k1"].to_numpy(), part["k2"].to_numpy()
                out.append(pd.DataFrame({"k1": k1[some], "k2": k2[some], "r1": k1[root[some]], "r2": k2[root[some]], "links": links[some]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("k1", "k2", "r1", "r2", "links")})

    return materialize(sent.groupBy("g", "i", "j").applyInPandas(compare, "k1 long, k2 long, r1 long, r2 long, links long"))


def linked_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Symmetric boolean matrix: Jaccard similarity of two different sets is at least ``similarity``, in exact integers."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    both = np.zeros(m * m, dtype=np.int64)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    first = np.concatenate([[0], np.cumsum(df)])[:-1]
    for f in np.unique(df[(df > 1) & (df <= 64)]):  # a rare shingle: its pairs one by one
        members = row[first[df == f][:, None] + np.arange(f)]
        i, j = np.triu_indices(f, 1)
        lo, hi = members[:, i].ravel(), members[:, j].ravel()
        at, times = np.unique(lo * m + hi, return_counts=True)
        both[at] += times
    both = both.reshape(m, m)
    both = both + both.T
    wide = np.flatnonzero(df > 64)  # a common one: by products of indicator matrices, some columns at a time
    for lo in range(0, len(wide), 2048):
        part = wide[lo : lo + 2048]
        x = np.zeros((m, len(part)), dtype=np.float32)
        for k, c in enumerate(part):
            x[row[first[c] : first[c] + df[c]], k] = 1
        both += np.rint(x @ x.T).astype(np.int64)
    share = Fraction(similarity).limit_denominator(1_000_000)
    linked = both * (share.numerator + share.denominator) >= share.numerator * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    return linked


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that links join each index with."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
