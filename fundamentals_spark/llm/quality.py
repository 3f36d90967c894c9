"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import SPACES, fresh

#: Frequent function words of English, French, German and Spanish, used for the stop-word ratio.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "this", "by",
    "le", "la", "les", "de", "des", "et", "que", "pour", "un", "une", "en", "du", "qui", "dans", "sur",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "auf", "im", "es",
    "el", "los", "las", "y", "por", "con", "para", "se", "no", "una", "del", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` must hold; a bound that is None does not apply, a null metric passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Bounds are wide on purpose: a clean text of any of the four languages stays inside them.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.6),
    Rule("stop_word_ratio", None, 0.9),
    Rule("long_word_ratio", None, 0.5),
    Rule("echo_ratio", None, 0.3),
)


def compile_rules(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> Column:
    """One boolean Column: true where every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        m = metrics[rule.metric]
        if rule.low is not None:
            verdict = verdict & F.coalesce(m >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(m <= rule.high, F.lit(True))
    return verdict


def with_quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "quality") -> tuple[DataFrame, str]:
    """``df`` with one struct column of counts, base verdict and verdict; also returns the name that the column got.

    The struct holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept. A null text counts
    as empty: no words, base_failed true. Rows are treated alone, so repeated rows get equal results and an empty table
    gives an empty table. Repeated 8-word windows are found by 64-bit hashes within one text.
    """
    cols = list(df.columns)
    names = {}
    for k in ("text", "words", "h", "h2", "h4", "h8", "rep"):
        names[k] = fresh(df, f"__q_{k}")
    n = names
    out = df.withColumn(n["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    trimmed = F.btrim(F.col(n["text"]), F.lit(SPACES))
    out = out.withColumn(n["words"], F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(n["h"], F.expr(f"transform({n['words']}, w -> xxhash64(w))"))
    size = f"size({n['words']})"

    def paired(source: str, shift: int, lost: int) -> Column:
        return F.expr(f"if({size} >= 8, zip_with(slice({source}, 1, {size} - {lost}), slice({source}, {shift + 1}, {size} - {lost}), (a, b) -> xxhash64(a, b)), array())")

    out = out.withColumn(n["h2"], paired(n["h"], 1, 1)).withColumn(n["h4"], paired(n["h2"], 2, 3))
    # a window of 8 words that repeats begins with 4 that do, so texts without such need no windows of 8
    again = F.expr(f"size(array_distinct({n['h4']})) < size({n['h4']})")
    out = out.withColumn(n["h8"], F.when(again, paired(n["h4"], 4, 7)).otherwise(F.array().cast("array<bigint>")))
    h8 = n["h8"]
    # positions of windows whose hash has an equal neighbour in hash order, in text order
    at = f"sort_array(filter(transform(sequence(0, size(s) - 1), j -> if(get(s, j).h <=> get(s, j - 1).h or get(s, j).h <=> get(s, j + 1).h, get(s, j).i, null)), x -> x is not null))"
    covered = "aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> least(8, b - a)), 8, (x, y) -> x + y)"
    in_order = f"transform(array(sort_array(transform({h8}, (h, i) -> struct(h as h, i as i)))), s -> {at})"
    out = out.withColumn(n["rep"], F.expr(f"if(size(array_distinct({h8})) < size({h8}), cast(element_at(transform({in_order}, p -> {covered}), 1) as bigint), 0L)"))

    words, text = F.col(n["words"]), F.col(n["text"])
    n_words = F.size(words).cast("long")
    word_chars = F.length(F.array_join(words, "")).cast("long")
    n_symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    lines = F.expr(f"filter(split({n['text']}, '\\n', -1), l -> length(btrim(l, '{_sql(SPACES)}')) > 0)")
    n_lines = F.size(lines).cast("long")
    n_dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    counts = F.struct(
        n_words.alias("n_words"), word_chars.alias("word_chars"), n_symbols.alias("n_symbols"), n_dup.alias("n_dup_lines"), F.col(n["rep"]).alias("n_repeat_words"),
        n_lines.alias("n_lines"), F.expr(f"size(filter({n['words']}, w -> lower(w) in ({', '.join(repr(w) for w in STOP_WORDS)})))").cast("long").alias("n_stop"),
        F.expr(f"size(filter({n['words']}, w -> length(w) > 30))").cast("long").alias("n_long"),
        F.expr(f"if({size} >= 2, size(filter(zip_with(slice({n['h']}, 1, {size} - 1), slice({n['h']}, 2, {size} - 1), (a, b) -> a = b), e -> e)), 0)").cast("long").alias("n_echo"),
    )
    name = fresh(df, name)
    # through explode, as a filter on the verdict would else be pushed down and repeat all of the above
    out = out.select(*[F.col(f"`{c}`") for c in cols], F.explode(F.array(counts)).alias(name))
    c = lambda k: F.col(f"`{name}`.{k}")
    metrics = {
        "mean_word_chars": F.try_divide(c("word_chars"), c("n_words")), "symbol_ratio": F.try_divide(c("n_symbols"), c("n_words")), "dup_line_ratio": F.try_divide(c("n_dup_lines"), c("n_lines")),
        "stop_word_ratio": F.try_divide(c("n_stop"), c("n_words")), "long_word_ratio": F.try_divide(c("n_long"), c("n_words")), "echo_ratio": F.try_divide(c("n_echo"), c("n_words")),
    }
    failed = (c("n_words") < 20) | (c("n_repeat_words") * 100 > c("n_words") * 30)
    kept = ~failed & compile_rules(rules, metrics)
    return out.withColumn(name, F.struct(*[c(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), kept.alias("kept"))), name


def _sql(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\x0b", "\\u000b").replace("\f", "\\u000c")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict for every row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Nulls, empty texts, ties and repeated rows: see ``with_quality``; other columns of ``df`` are not read.
    """
    out, q = with_quality(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    return out.select(F.col("doc_id").alias(id_col), f"{q}.*")
