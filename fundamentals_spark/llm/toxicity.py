"""Toxicity grades by cumulative-link ordinal regression over hashed words and character n-grams.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds, which stay in order. The expected grade is
the sum over k of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm import bytehash
from fundamentals_spark.llm.common import discard, materialize

BITS = 20
#: Lengths in bytes of the character n-grams inside words.
GRAMS = (3, 4, 5, 6)
#: The fit takes at most so many labelled documents, those lowest in hash order of their id.
SAMPLE = 8000
#: Standard errors by which a feature's shares among toxic and other documents differ, documents that hold it, and how many features take part at most.
SCREEN, LEAST, FEATURES = 4.0, 5, 20_000
#: Grades 0 .. GRADES - 1; 0 is not toxic.
GRADES = 4
#: A document counts as toxic from this chance of a grade over 0 on.
DECISION = 0.25
CHUNK = 1 << 20


def _letters() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[97:123] = t[65:91] = True
    t[128:] = True
    return t


_LETTERS, _LOWER = _letters(), bytehash.lower_table()


def _lower_accents(buf: np.ndarray) -> np.ndarray:
    """Capital Latin-1 letters in UTF-8 (C3 80 to C3 9E without C3 97) become small ones."""
    after = np.zeros(len(buf), dtype=bool)
    after[1:] = buf[:-1] == 0xC3
    return np.where(after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), buf + np.uint8(0x20), buf)


def _buckets(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, features) of whole words, then of the n-grams of each length; an n-gram knows whether it begins or ends its word."""
    starts, ends, rows = bytehash.word_spans(buf, offsets, _LETTERS)
    prefix = bytehash.prefix_hash(_lower_accents(buf), _LOWER)
    yield rows, bytehash.mix(bytehash.substring_hash(prefix, starts, ends)) >> np.uint64(64 - BITS)
    size = ends - starts
    first = np.repeat(starts, size)
    at = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size) + first
    left = np.repeat(ends, size) - at
    row = np.repeat(rows, size)
    whole = (buf[at] & 0xC0) != 0x80  # not inside a character
    for n in GRAMS:
        take = whole & (left >= n)
        p = at[take]
        mark = (p == first[take]).astype(np.uint64) + np.uint64(2) * (left[take] == n).astype(np.uint64) + np.uint64(4 * n)
        h = bytehash.substring_hash(prefix, p, p + n) + mark * np.uint64(0xD6E8FEB86659FD93)
        yield row[take], bytehash.mix(h) >> np.uint64(64 - BITS)


def features(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, log(1 + count)) of hashed words and n-grams without case, in row order; a word is a run of letters.

    ``wanted`` is a mask of the features to return; all if None.
    """
    keys = []
    for rows, bucket in _buckets(buf, offsets):
        if wanted is not None:
            keep = wanted[bucket]
            rows, bucket = rows[keep], bucket[keep]
        keys.append((rows.astype(np.uint64) << np.uint64(BITS)) | bucket)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.log1p(count)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row of scores and k."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def grade_labels(row: np.ndarray, feat: np.ndarray, toxic: np.ndarray, least: int = 5) -> np.ndarray:
    """Grades for rows labelled only toxic or not: 0 if not; else 1 .. GRADES - 1 by how many words of the document are
    marked, at quantiles of that number. A word is marked if at least ``least`` toxic rows hold it and its share among
    toxic rows is over eight times its smoothed share among the others."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    df1 = np.bincount(feat, weights=toxic[row], minlength=1 << BITS)
    df0 = np.bincount(feat, weights=1 - toxic[row], minlength=1 << BITS)
    marked = (df1 >= least) & (df1 / n1 > 8 * (df0 + 1) / n0)
    hits = np.bincount(row, weights=marked[feat], minlength=len(toxic))
    graded = np.zeros(len(toxic), dtype=np.int64)
    with_hits = (toxic == 1) & (hits > 0)
    if with_hits.any():
        cuts = np.quantile(hits[with_hits], np.arange(1, GRADES - 1) / (GRADES - 1))
        graded[with_hits] = 1 + np.searchsorted(cuts, hits[with_hits], side="left")
    graded[(toxic == 1) & (hits == 0)] = 1
    return graded


def objective(beta: np.ndarray, theta: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, drawn: np.ndarray, l2: float, noise: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with its penalty, and its gradients by the weights and by the thresholds' parameters.

    ``theta`` holds the first threshold and the logarithms of the steps; ``drawn`` is each row's chance if its label is noise.
    """
    n, grades = len(grade), len(theta) + 1
    z = np.bincount(row, weights=beta[col] * value, minlength=n)
    cut = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
    edge = np.concatenate([[-60.0], cut, [60.0]])
    p = 1.0 / (1.0 + np.exp(-np.clip(edge[None, :] - z[:, None], -60, 60)))
    p[:, 0], p[:, -1] = 0.0, 1.0
    idx = np.arange(n)
    hi, lo = p[idx, grade + 1], p[idx, grade]
    prob = np.maximum((1 - noise) * (hi - lo) + drawn, 1e-9)
    d_hi, d_lo = (1 - noise) * hi * (1 - hi) / prob, (1 - noise) * lo * (1 - lo) / prob
    d_edge = np.bincount(grade + 1, weights=-d_hi / n, minlength=grades + 1) + np.bincount(grade, weights=d_lo / n, minlength=grades + 1)
    d_cut = d_edge[1:-1]
    g_theta = np.concatenate([[d_cut.sum()], np.array([d_cut[k:].sum() for k in range(1, grades - 1)]) * np.exp(theta[1:])])
    g_beta = np.bincount(col, weights=((d_hi - d_lo) / n)[row] * value, minlength=len(beta)) + l2 * beta
    return float(-np.log(prob).mean() + l2 * (beta @ beta) / 2), g_beta, g_theta


def fit_ordinal(row: np.ndarray, feat: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES, l2: float = 1e-4, steps: int = 400, screen: float = SCREEN, least: int = LEAST, noise: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by Adam on all rows; thresholds are a first value and positive steps.

    Features that at least ``least`` rows hold and whose share among rows of grade over 0 differs from that among the others
    by at least ``screen`` standard errors take part (all, if ``screen`` is 0); rows with equal features on the same side count once there. A share
    ``noise`` of labels is taken as drawn by the grades' frequencies: a row that the model contradicts pulls less, but
    no row is left out, and a model that knows only the frequencies weighs all rows alike.
    """
    n = len(grade)
    w = np.zeros(1 << BITS)
    theta = np.concatenate([[1.0], np.zeros(grades - 2)])  # first threshold, log of steps
    if n == 0:
        return OrdinalModel(w, np.full(grades - 1, 60.0))
    sketch = np.zeros(n, dtype=np.uint64)
    np.add.at(sketch, row, bytehash.mix((feat.astype(np.uint64) << np.uint64(32)) + (value * 1e6).astype(np.uint64)))
    once = np.zeros(n, dtype=bool)
    once[np.unique(np.stack([sketch, (grade > 0).astype(np.uint64)]), axis=1, return_index=True)[1]] = True
    high, low = (once & (grade > 0)).astype(float), (once & (grade == 0)).astype(float)
    n1, n0 = max(high.sum(), 1.0), max(low.sum(), 1.0)
    in1 = np.bincount(feat, weights=high[row], minlength=1 << BITS)
    in0 = np.bincount(feat, weights=low[row], minlength=1 << BITS)
    share = np.clip((in1 + in0) / (n1 + n0), 1e-9, 1 - 1e-9)
    z = (in1 / n1 - in0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    use = ((np.abs(z) >= screen) & (in1 + in0 >= least) if screen else in1 + in0 > 0)[feat]
    names, col = np.unique(feat[use], return_inverse=True)
    r, v = row[use], value[use]
    beta = np.zeros(len(names))
    m = [np.zeros_like(beta), np.zeros_like(theta)]
    s = [np.zeros_like(beta), np.zeros_like(theta)]
    drawn = noise * (np.bincount(grade, minlength=grades) / n)[grade]
    for t in range(1, steps + 1):
        _, g_beta, g_theta = objective(beta, theta, r, col, v, grade, drawn, l2, noise)
        for k, (x, g) in enumerate(((beta, g_beta), (theta, g_theta))):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            x -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    w[names] = beta
    return OrdinalModel(w, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def _scan(df: DataFrame, handle, schema: str, wanted=None) -> DataFrame:
    """``handle(batch, row, feat, value)`` over chunks of rows; ``wanted`` is a broadcast list of the features that count."""

    def run(batches):
        mask = None
        if wanted is not None:
            mask = np.zeros(1 << BITS, dtype=bool)
            mask[wanted.value] = True
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                row, feat, value = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mask)
                yield handle(batch.slice(i, j - i), row, feat, value)

    return df.mapInArrow(run, schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic and text of at most ``sample`` labelled documents, written to the shared folder; one row for each id and each text."""
    wanted = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")  # at most ``sample`` rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("toxic", "text"), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("doc_id")).alias("r"))
    return materialize(rows.select("r.doc_id", "toxic", "r.text").repartition(max(8, sample // 250), "doc_id"))


def select_features(rows: DataFrame, screen: float = SCREEN, least: int = LEAST, most: int = FEATURES) -> np.ndarray:
    """Features whose share among the toxic rows differs from that among the others by ``screen`` standard errors and which
    ``least`` rows hold; the ``most`` farthest. Rows are counted in the tasks; the driver gets only what is selected."""

    def count(batches):
        held = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            toxic = np.asarray(batch.column("toxic")) > 0
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                row, feat, _ = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                side = toxic[i:j][row]
                held[1] += np.bincount(feat[side], minlength=1 << BITS).astype(np.int32)
                held[0] += np.bincount(feat[~side], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(held.any(axis=0))
        for part in np.array_split(some, max(1, len(some) // 65536)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[1, part]), pa.array(held[0, part])], names=["feat", "in1", "in0"])

    sides = rows.agg(F.count_if(F.col("toxic") > 0).alias("n1"), F.count_if(F.col("toxic") <= 0).alias("n0")).first()
    n1, n0 = F.lit(float(max(1, sides["n1"]))), F.lit(float(max(1, sides["n0"])))
    share = F.greatest((F.col("in1") + F.col("in0")) / (n1 + n0), F.lit(1e-9))
    z = (F.col("in1") / n1 - F.col("in0") / n0) / F.sqrt(share * F.greatest(1 - share, F.lit(1e-9)) * (1 / n1 + 1 / n0))
    counts = rows.mapInArrow(count, "feat int, in1 int, in0 int").groupBy("feat").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    far = counts.withColumn("z", F.abs(z)).filter((F.col("in1") + F.col("in0") >= least) & (F.col("z") >= screen)).orderBy(F.desc("z"), "feat").limit(most)
    return np.sort(np.array([r["feat"] for r in far.select("feat").collect()], dtype=np.int64))


def train_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents. Null ids and labels are left out; of repeated labels the highest counts,
    of repeated documents one, and equal texts with equal labels count once.

    Without labels the model gives grade 0 to all. Texts stay in the tasks; the driver gets the selected features (at most
    FEATURES) of the sample.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = labelled_sample(docs, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")), sample)
    chosen = select_features(rows)
    wanted = rows.sparkSession.sparkContext.broadcast(chosen)

    def handle(batch, row, feat, value):
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(cuts, pa.array(feat.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32)))],
            names=["doc_id", "toxic", "feat", "value"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    t = _scan(rows, handle, f"doc_id {kind}, toxic int, feat array<int>, value array<float>", wanted).toPandas().sort_values("doc_id", kind="stable")
    discard(rows)
    lengths = np.array([len(x) for x in t["feat"]], dtype=np.int64)
    row = np.repeat(np.arange(len(t)), lengths)
    feat = np.concatenate([np.asarray(x, dtype=np.int64) for x in t["feat"]]) if len(t) else np.zeros(0, dtype=np.int64)
    value = np.concatenate([np.asarray(x, dtype=np.float64) for x in t["value"]]) if len(t) else np.zeros(0)
    toxic = (t["toxic"].to_numpy(dtype=np.int64) > 0).astype(np.int64) if len(t) else np.zeros(0, dtype=np.int64)
    return fit_ordinal(row, feat, value, grade_labels(row, feat, toxic), screen=0)


def score_toxicity(documents: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (expected grade), grade (the most likely) and toxic (P(grade > 0) of at least DECISION) for every row.

    A null or empty text has no features and gets what the thresholds alone say. Repeated rows get equal results; an empty
    table gives an empty one; other columns are not read. The features with a weight go out with the tasks.
    """
    context = documents.sparkSession.sparkContext
    used = np.flatnonzero(model.weights)
    wanted, shared = context.broadcast(used), context.broadcast((model.weights[used], model.thresholds))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def handle(batch, row, feat, value):
        weights, thresholds = shared.value
        z = np.bincount(row, weights=weights[np.searchsorted(wanted.value, feat)] * value, minlength=batch.num_rows)
        above = OrdinalModel(weights, thresholds).above(z)
        each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
        cols = [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= DECISION)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "severity", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scan(docs, handle, f"doc_id {kind}, severity double, grade int, toxic boolean", wanted).withColumnRenamed("doc_id", id_col)
