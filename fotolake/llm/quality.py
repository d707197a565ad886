"""Learned decision lists over text statistics.

Sequential covering on labelled rows: a rule grows by the threshold condition with the
highest information gain until it covers no kept row, is cut back from its end on held-out
rows, and joins the list if it is still precise there; the rows it covers leave, and the
next rule is grown. The list becomes one ordered ``when`` expression.

Defined results: a null text has no words and fails the base rule; repeated rows are
judged each; labels that are null are left out of the fit, labels of unknown documents
have no effect; without usable labels the list is empty and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import text_bytes, text_key

# Labelled rows that the fit takes, by hash order of their id: the bound of what the driver sees.
FIT_ROWS = 20_000

_SPACE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))

_COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_marks "
    "n_distinct n_bars"
).split()
_TYPE = pa.struct([(name, pa.int64()) for name in _COUNTS])
_SPARK_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in _COUNTS])


def _counts(text: bytes) -> tuple[int, ...]:
    own = text.split()
    n = len(own)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, n)
    repeated = 0
    if n >= 4:
        _, pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        _, window, times = np.unique(pair * n + ids[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : n - 2 + i] |= twice
        repeated = int(inside.sum())
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    size = len(text)
    return (
        n,
        len(text.translate(None, _SPACE + _CONTINUATION)),
        size - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        size - len(text.translate(None, _UPPER)),
        size - len(text.translate(None, b"0123456789")),
        text.count(b"!") + text.count(b"?"),
        len(number),
        text.count(b"|"),
    )


@F.arrow_udf(_SPARK_TYPE)
def text_counts(texts: pa.Array) -> pa.Array:
    rows = [_counts(text.as_py()) for text in texts]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_COUNTS)
    return pa.StructArray.from_arrays(
        [pa.array(column, pa.int64()) for column in columns], fields=list(_TYPE)
    )


def counts(column: str = "text") -> Column:
    """Statistics of a whole text as one struct of longs, null texts as empty ones."""
    return text_counts(text_bytes(column))


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def features() -> dict[str, Column]:
    """What rules may test, over the columns of the statistics."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "digit_share": _ratio("n_digits", "word_chars"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "distinct_share": _ratio("n_distinct", "n_words"),
        "bars_per_word": _ratio("n_bars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        value = x[:, names.index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for condition in rule:
        inside &= condition.covers(x, names)
    return inside


def _best_condition(x, bad, names) -> tuple[float, Condition] | None:
    """The condition with the highest gain: bad rows kept times the bits won on each."""
    p, n = int(bad.sum()), int((~bad).sum())
    before = np.log2(p / (p + n))
    best = None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        value = x[order, j]
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        low_p = np.cumsum(bad[order])[cut]
        low_n = cut + 1 - low_p
        for above in (False, True):
            q, m = (p - low_p, n - low_n) if above else (low_p, low_n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(q > 0, q * (np.log2(q / (q + m)) - before), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                middle = float((value[cut[i]] + value[cut[i] + 1]) / 2)
                best = float(gain[i]), Condition(name, above, middle)
    return best


def _grow(x, bad, names) -> Rule:
    rule: list[Condition] = []
    while bad.any() and not bad.all():
        found = _best_condition(x, bad, names)
        if found is None:
            break
        inside = found[1].covers(x, names)
        x, bad = x[inside], bad[inside]
        rule.append(found[1])
    return tuple(rule)


def _prune(rule: Rule, x, bad, names) -> tuple[Rule, float, int]:
    """The head of the rule with the best (bad - good) / covered on held-out rows."""
    best = (-2.0, 0, 0.0, 0)
    for size in range(1, len(rule) + 1):
        inside = _covered(rule[:size], x, names)
        total, p = int(inside.sum()), int(bad[inside].sum())
        worth = (2 * p - total) / total if total else -1.0
        if worth > best[0]:
            best = worth, size, p / total if total else 0.0, p
    return rule[: best[1]], best[2], best[3]


def fit_rules(
    x: np.ndarray,
    bad: np.ndarray,
    names: list[str],
    min_precision: float = 0.97,
    max_rules: int = 24,
    min_covered: int = 3,
    seed: int = 7,
) -> list[Rule]:
    """An ordered list of conjunctions that pick the bad rows."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    misses = 0
    while len(rules) < max_rules and misses < 3 and bad.sum() >= min_covered:
        held = rng.random(len(x)) < 1 / 3
        if bad[~held].all() or not bad[~held].any():
            break
        rule = _grow(x[~held], bad[~held], names)
        rule, precision, covered = _prune(rule, x[held], bad[held], names)
        inside = _covered(rule, x, names)
        overall = bad[inside].mean() if inside.any() else 0.0
        if not rule or min(precision, overall) < min_precision or covered < 1:
            misses += 1
            continue
        rules.append(rule)
        x, bad = x[~inside], bad[~inside]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules for documents of quality 0, from ``doc_id, text`` and ``doc_id, quality``.

    At most ``fit_rows`` labels take part, each with one row of its document, so the join
    side and what the driver receives are bounded.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int"))
        .dropna()
        .orderBy(F.xxhash64("_id"), "_id", "quality")
        .limit(fit_rows)
    )
    own = features()
    ids = chosen.select("_id").distinct()
    # Rows of one doc_id are one: that with the smallest text key.
    counted = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .select("_id", text_key().alias("_key"), counts().alias("_c"))
        .groupBy("_id")
        .agg(F.min_by("_c", "_key").alias("_c"))
    )
    rows = (
        counted.join(F.broadcast(chosen), "_id")
        .select("_id", "quality", "_c.*")
        .select("_id", "quality", *(column.alias(name) for name, column in own.items()))
        .toPandas()
        .sort_values(["_id", "quality", *own], kind="stable")
    )
    names = list(own)
    if rows.empty:
        return []
    return fit_rules(rows[names].to_numpy(float), (rows["quality"] == 0).to_numpy(), names)


def rejects(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over ``features()``."""
    verdict: Column | None = None
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test &= condition.column()
        verdict = F.when(test, True) if verdict is None else verdict.when(test, True)
    return F.lit(False) if verdict is None else verdict.otherwise(False)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with a struct ``quality_counts`` and booleans ``base_failed`` and ``kept``.

    The text passes through one scan; nothing is shuffled.
    """
    own = features()
    inner = docs.select(F.struct("*").alias("_row"), counts().alias("_c")).select("_row", "_c", "_c.*")
    for name, column in own.items():
        if name not in _COUNTS:
            inner = inner.withColumn(name, column)
    return inner.withColumn("_bad", rejects(rules)).select(
        "_row.*",
        F.col("_c").alias("quality_counts"),
        base_failed().alias("base_failed"),
        (~(base_failed() | F.col("_bad"))).alias("kept"),
    )
