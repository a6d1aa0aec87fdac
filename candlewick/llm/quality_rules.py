"""Quality rules: base counts of a text, and a decision list learned by sequential covering.

Features are DataFrame expressions, one pass over each text. The list is learned from labelled rows: each rule is a conjunction of
thresholds, grown by FOIL's information gain on two thirds of them, pruned on the other third, and kept only if it covers enough rows and is
precise on the pruning third as on all rows; what a rule covers is
removed before the next is grown. The rules are emitted as one ordered conditional expression. Windows of words are known by 64-bit hashes:
two different ones among n of a text meet with a chance of n^2 / 2^65.

Defined cases: a null text has no words (it fails the base rule); labels that are null or of unknown documents are ignored, of several
labels for one document the highest counts; without labels of both kinds the list is empty; repeated rows give repeated results; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Inputs of the rules, as expressions over the counts.
RATIOS = {
    "word_length": "try_divide(word_chars, n_words)",
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "dup_lines": "try_divide(n_dup_lines, n_words)",
    "repeated": "try_divide(n_repeat_words, n_words)",
    "variety": "try_divide(ln(n_distinct), ln(n_words))",  # level over texts of any length, unlike distinct words per word
    "capitals_per_char": "try_divide(n_capitals, word_chars)",
    "marks_per_word": "try_divide(n_marks, n_words)",
    "words": "CAST(n_words AS double)",
}


def counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, and the counts of the text. Each step's arrays are columns of their own, so none is computed twice."""
    df = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    df = df.select(
        *keep,
        F.array_remove(F.split("__t", SPACE), "").alias("__words"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("__t", F.lit(r"[!?|{}]")).cast("long").alias("n_marks"),
        F.expr(r"filter(split(__t, '\n', -1), l -> l RLIKE '[^ \\t-\\r]')").alias("__lines"),
    )
    done = [*keep, "n_symbols", "n_capitals", "n_marks"]
    df = df.select(
        *done,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    done += ["n_words", "word_chars", "n_dup_lines"]
    df = df.select(
        *done,
        F.size(F.array_distinct("__h")).cast("long").alias("n_distinct"),
        F.expr(f"IF(size(__h) < {WINDOW}, CAST(array() AS array<bigint>), transform(sequence(1, greatest(size(__h) - {WINDOW - 1}, 1)), i -> xxhash64(slice(__h, i, {WINDOW}))))").alias("__win"),
    )
    done += ["n_distinct"]
    # Few texts repeat a window; only theirs are sorted.
    df = df.select(*done, F.expr("IF(size(array_distinct(__win)) = size(__win), array(), sort_array(transform(__win, (h, i) -> struct(h, i))))").alias("__sorted"))
    last = "size(__sorted) - 1"
    df = df.select(
        *done,
        F.expr(f"""sort_array(transform(filter(transform(__sorted, (x, k) -> struct(x.i AS i,
            (k > 0 AND __sorted[greatest(k - 1, 0)].h = x.h) OR (k < {last} AND __sorted[least(k + 1, {last})].h = x.h) AS twice)), y -> y.twice), y -> y.i))""").alias("__at"),
    )
    covered = f"aggregate(__at, struct(-{WINDOW} AS was, 0L AS n), (a, p) -> struct(p AS was, a.n + least({WINDOW}, p - a.was) AS n), a -> a.n)"
    # Behind a generator: else a filter on a count would be pushed below these steps, and compute them anew for every element.
    made = [c for c in done if c not in keep]
    return df.select(*keep, F.inline(F.array(F.struct(*made, F.expr(covered).alias("n_repeat_words")))))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """All of (feature, at least or at most, threshold) must hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            c = F.expr(RATIOS[f])
            out = out & ((c >= t) if op == ">=" else (c <= t))
        return F.coalesce(out, F.lit(False))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.conditions:
            out &= (x[f] >= t) if op == ">=" else (x[f] <= t)
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, precision: float = 0.97, support: int = 4, cuts: int = 48) -> list[Rule]:
    """Sequential covering of the bad rows; rules in the order they were found."""
    if not bad.any() or bad.all():
        return []
    third = np.arange(len(bad)) % 3 == 0
    left, rules = np.ones(len(bad), bool), []
    steps = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts))) for f, v in x.items()}
    for f, v in x.items():  # cuts where the bad rows lie, which may be few
        steps[f] = np.unique(np.concatenate([steps[f], np.quantile(v[bad], np.linspace(0, 1, cuts))]))
    for _ in range(max_rules):
        grow = left & ~third
        rule = _grow(x, bad, grow, steps)
        rule = _prune(rule, x, bad, left & third)
        if not rule.conditions:
            break
        cover = rule.holds(x) & left
        if (cover & bad).sum() < support or any((cover & bad & part).sum() < precision * (cover & part).sum() for part in (third, left)):
            break
        rules.append(rule)
        left &= ~cover
        if not (left & bad).any():
            break
    return rules


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, steps: dict[str, np.ndarray]) -> Rule:
    rule, cover = Rule(()), rows.copy()
    while (cover & ~bad).any() and len(rule.conditions) < 4:
        p0, n0 = int((cover & bad).sum()), int((cover & ~bad).sum())
        if not p0:
            break
        best = (1e-9, None)
        for f, v in x.items():
            vp, vn, t = np.sort(v[cover & bad]), np.sort(v[cover & ~bad]), steps[f]
            for op, p, n in ((">=", len(vp) - np.searchsorted(vp, t), len(vn) - np.searchsorted(vn, t)), ("<=", np.searchsorted(vp, t, "right"), np.searchsorted(vn, t, "right"))):
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, op, float(t[k])))
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        cover = rows & rule.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on the pruning rows."""

    def worth(r: Rule) -> float:
        cover = rows & r.holds(x)
        p, n = int((cover & bad).sum()), int((cover & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    if not rows.any() or len(rule.conditions) < 2:
        return rule
    return max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=lambda r: (worth(r), -len(r.conditions)))


def learn_from(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = 20_000) -> list[Rule]:
    """The list learned from labelled documents (labels: doc_id, quality; 0 is bad).

    At most `sample` labelled documents, those first by a hash of doc_id, are learned from; they reach the driver as a few numbers each.
    """
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(wanted), "doc_id")
    table = counts(rows, "text", ["doc_id", "quality"]).where(~base_failed())
    got = table.select((F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("h"), *[F.expr(e).cast("double").alias(f) for f, e in RATIOS.items()]).collect()
    got.sort(key=lambda r: (r["h"], *[r[f] for f in RATIOS]))
    if not got:
        return []
    return learn({f: np.array([r[f] for r in got]) for f in RATIOS}, np.array([r["bad"] for r in got]))


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.column(), F.lit(str(r))).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, whether the base rule fails, whether it is kept, and the rule that rejects it."""
    df = counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"])
    df = df.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
