"""Exact top-k inner products by norm buckets.

Candidates fall into buckets of similar length, queries into blocks. The longest candidates give every query a first bound
on its k-th score. A bucket whose greatest length cannot reach a query's bound is skipped for it. In a bucket left over, the
local cosine threshold (bound over both lengths) chooses the pruning: by single coordinates where it is high, by length
where it is low. Products of what remains are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import materialize

#: Ratio of lengths inside a bucket, rows of a bucket's part, bytes of the query vectors of a block. A candidate is copied at
#: most once for each block, so blocks are as large as a task can hold.
RATIO, PART_ROWS, BLOCK_BYTES = 1.05, 8192, 32 << 20
#: Local cosine threshold from which coordinates prune.
COORDINATE_FROM = 0.6
#: Rows, of the longest, that give the first bounds.
SEED_ROWS = 2048


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>, norm double) with v = floor(scale * x); rows that are null or hold null or non-finite components go, and rows equal in id and vector count once."""
    x = F.col("x")
    ok = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter(ok)
    v = v.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v")).distinct()
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where no sum can pass 2**53, else by integers."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, bound: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best of ``c`` for every query, those that can reach its bound, by score and then smaller id."""
    out_q, out_c, out_s = [], [], []
    c_norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-c_norm, kind="stable")
    cid, c, c_norm = cid[order], c[order], c_norm[order]
    q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    top = c_norm[0] if len(c_norm) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_norm * top > 0, bound / (q_norm * top), -np.inf)
    unit = None
    for lo in range(0, len(q), 128):
        rows = np.arange(lo, min(len(q), lo + 128))
        # length pruning: candidates are in order of length, so a query needs a first part of them
        need = np.where(bound[rows] > 0, bound[rows] / np.maximum(q_norm[rows], 1e-300) * (1 - 1e-9), -np.inf)
        counts = np.searchsorted(-c_norm, -need, side="right")
        wide = int(counts.max(initial=0))
        if not wide:
            continue
        chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sharp = cosine[rows] >= COORDINATE_FROM
        if sharp.any():
            # coordinate pruning: a vector within angle arccos(t) of the query lies, seen from an axis, between the query's
            # angle less that and the query's angle plus that; a shorter candidate needs a higher cosine, so t is safe for all
            if unit is None:
                unit = c / np.maximum(c_norm, 1e-300)[:, None]
            for r in np.flatnonzero(sharp):
                within = np.arccos(min(1.0, cosine[rows[r]]))
                g = q[rows[r]] / q_norm[rows[r]]
                at = np.arange(counts[r])
                for f in np.argsort(-np.abs(g))[:3]:
                    angle = np.arccos(np.clip(g[f], -1, 1))
                    least, most = np.cos(min(np.pi, angle + within)), np.cos(max(0.0, angle - within))
                    at = at[(unit[at, f] >= least - 1e-9) & (unit[at, f] <= most + 1e-9)]
                chosen[r] = at, _products(q[rows[r]][None, :], c[at])[0]  # only what the coordinates leave is multiplied
        dense = np.flatnonzero(~sharp)
        score = _products(q[rows[dense]], c[: int(counts[dense].max(initial=0))])
        for n, r in enumerate(dense):
            chosen[r] = np.arange(counts[r]), score[n, : counts[r]]
        for r, x in enumerate(rows):
            at, s = chosen[r]
            keep = (s >= bound[x]) & (cid[at] != qid[x])
            at, s = at[keep], s[keep]
            if len(at) > k:
                top = s >= np.partition(s, len(s) - k)[len(s) - k]
                at, s = at[top], s[top]
            best = np.lexsort((cid[at], -s))[:k]
            out_q += [qid[x]] * len(best)
            out_c += cid[at[best]].tolist()
            out_s += s[best].tolist()
    return out_q, out_c, out_s


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(np.int64)


RESULT = "query_id long, vec_id long, score long"


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates with the highest integer product, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. A query's own id
    is no candidate of it. Rows equal in id and vector count once. Fewer than k candidates give all. Vectors of different
    lengths are not compared. Empty tables give an empty result. Scores must fit a 64-bit integer.
    """
    c = integer_vectors(candidates, id_col, vector_col, scale)
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(RATIO)))).otherwise(F.lit(-1)).cast("long")
    c = materialize(c.withColumns({"dim": F.size("v"), "bucket": bucket}))
    q = materialize(integer_vectors(queries, id_col, vector_col, scale).withColumns({"dim": F.size("v")}))
    # parts of buckets with about PART_ROWS rows, dealt by hash; the table of parts has a row for each
    sizes = c.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("long"))
    c = c.join(sizes.select("dim", "bucket", "parts"), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    n_blocks = max(1, -(-(q.agg(F.sum(F.col("dim") * 8)).first()[0] or 0) // BLOCK_BYTES))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks)))

    seeds = c.orderBy(F.col("norm").desc(), "vec_id").limit(SEED_ROWS)  # a fixed number of rows
    first = _joined(q.withColumn("bound", F.lit(None).cast("long")), seeds.withColumns({"bucket": F.lit(0).cast("long"), "part": F.lit(0).cast("long")}), q.select("dim", "block").distinct().withColumns({"bucket": F.lit(0).cast("long"), "part": F.lit(0).cast("long")}), k)
    ranked = first.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    bounds = ranked.filter(f"r = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    # a block goes to the parts that one of its queries needs: bound <= |q| * longest of the bucket
    # a query without a bound, or of length 0, whose scores are all 0, needs every part
    least = F.coalesce(F.try_divide(F.col("bound").cast("double"), "norm"), F.lit(float("-inf")))
    q = q.join(bounds, "vec_id", "left")
    if n_blocks > 1:  # queries of similar need share a block, so that few blocks need the short buckets; one number a block
        cuts = q.agg(F.percentile_approx(least, [i / n_blocks for i in range(1, n_blocks)])).first()[0] or []
        q = q.withColumn("block", F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x < least)).cast("long"))
        at_most = F.floor((F.count(F.lit(1)) - 1) * F.max("dim") * 8 / (2 * BLOCK_BYTES)) + 1  # many equal needs: split by hash
        split = q.groupBy("dim", "block").agg(at_most.alias("splits"))
        q = q.join(split, ["dim", "block"]).withColumn("block", F.col("block") + n_blocks * F.pmod(F.xxhash64("vec_id"), F.col("splits"))).drop("splits")
    q = materialize(q)
    blocks = q.groupBy("dim", "block").agg(F.max("norm").alias("most"), F.min(least).alias("least"))
    pairs = blocks.join(sizes, "dim").filter(F.coalesce(F.col("top") * (1 + 1e-9) >= F.col("least"), F.lit(True)))
    pairs = pairs.select("dim", "block", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    found = _joined(q, c, pairs, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _joined(q: DataFrame, c: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Best k of each candidate part for each query of the blocks that ``pairs`` sends there; a task holds one block and one part."""
    key = ["dim", "block", "bucket", "part"]
    left = q.join(pairs, ["dim", "block"]).select(*key, "vec_id", "v", "bound")
    right = c.join(pairs, ["dim", "bucket", "part"]).select(*[F.col(x).alias(f"c_{x}") for x in key], "vec_id", "v")

    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        bound = qs["bound"].astype("float64").fillna(-np.inf).to_numpy()
        bound = np.where(np.isfinite(bound), bound - np.abs(bound) * 1e-12, bound)
        a, b, s = _best(qs["vec_id"].to_numpy(), _stack(qs["v"]), cs["vec_id"].to_numpy(), _stack(cs["v"]), bound, k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s}).astype("int64")

    return left.groupBy(*key).cogroup(right.groupBy(*[f"c_{x}" for x in key])).applyInPandas(run, RESULT)
