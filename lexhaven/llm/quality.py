"""Learned decision lists over text statistics, as ordered Spark conditions.

Statistics of every text come from built-in functions on its words. A list of rules is learned
from labelled rows by sequential covering: a rule grows threshold by threshold on two thirds
of the rows while it gains, is pruned on the last third, and leaves; what it covers is put aside
and the next one grows on the rest (after Fuernkranz and Widmer's incremental reduced error
pruning). Rules say which texts go; a text that meets none stays. The list becomes one
CASE WHEN expression, so Spark applies it within the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import SPACE

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# Labelled rows of each label to learn from, at most.
SAMPLE = 2000
# Rules must be this sure on the rows they were pruned on.
PRECISION = 0.95
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 4, 24
FEATURES = ("symbol_share", "upper_share", "digit_share", "repeat_share", "dup_line_share", "mean_word", "bar_share", "mark_share")


def _blank_first(words: Column) -> Column:
    """Words without the empty string that a split leaves before or after white space."""
    return F.filter(words, lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(by: int) -> Callable[[Column], Column]:
    """Hashes of each value with the one `by` places on."""

    def pairs(values: Column) -> Column:
        size = F.greatest(F.size(values) - by, F.lit(0))
        return F.zip_with(F.slice(values, 1, size), F.slice(values, by + 1, size), lambda a, b: F.xxhash64(a, b))

    return pairs


def _window_hashes(words: Column) -> Column:
    """Hashes of all windows of eight words, by doubling; empty for fewer words."""
    out = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        out = _let(out, _paired(step))
    return out


def _neighbours(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body` of each value and the next; of the last and NULL."""
    after = F.concat(F.slice(values, 2, F.size(values)), F.slice(values, F.size(values), 1))
    last = F.size(values) - 1
    return F.transform(
        F.zip_with(values, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda pair, i: body(pair["a"], F.when(i < last, pair["b"])),
    )


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash comes twice or more: the union of the windows' places."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Each place twice over where both neighbours have its hash; the union does not mind.
    equal = lambda v: F.flatten(_neighbours(v, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    places = _let(placed, lambda v: F.array_sort(F.array_distinct(equal(v))))
    widths = _let(places, lambda v: _neighbours(v, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda total, w: total + w)


def statistics(df: DataFrame, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Per row: key, n_words and the statistics. NULL and empty texts have zero of everything.

    Whole texts are read whatever their length. Other columns take no part; with `carry` the
    whole row comes along as `row`.
    """
    row = [F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else []
    also = ["row"] if carry else []
    base = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"), *row)
    words = _blank_first(F.split("text", SPACE))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    count = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    # Arrays are made once: a projection of its own for each step keeps them from being repeated.
    step = base.select(*also, "key", "text", words.alias("words"), lines.alias("lines"))
    step = step.select(*also, "key", "text", F.size("words").cast("long").alias("n_words"), _window_hashes(F.col("words")).alias("hashes"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"))
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return step.select(
        *also, "key", "n_words",
        count(SPACE).cast("long").alias("word_chars"),
        (F.length("text") - count("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.when(twice, _covered(F.col("hashes"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.length("text") - count("[A-Z]+")).cast("long").alias("n_upper"),
        (F.length("text") - count("[0-9]+")).cast("long").alias("n_digits"),
        (F.length("text") - count("[|]+")).cast("long").alias("n_bars"),
        (F.length("text") - count("[!?]+")).cast("long").alias("n_marks"),
        F.col("n_lines").cast("long").alias("n_lines"),
    ).withColumnRenamed("key", key)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def features() -> dict[str, Column]:
    """Statistics that do not depend on a text's length."""
    return {
        "symbol_share": _share("n_symbols", "word_chars"), "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"), "repeat_share": _share("n_repeat_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"), "mean_word": _share("word_chars", "n_words"),
        "bar_share": _share("n_bars", "n_words"), "mark_share": _share("n_marks", "word_chars"),
    }


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """A feature at least, or at most, as large as a threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.threshold if self.above else columns[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _thresholds(rows: list[dict], feature: str) -> list[float]:
    """Values that part the rows into about equal shares."""
    values = sorted({r[feature] for r in rows})
    step = max(1, len(values) // THRESHOLDS)
    return values[::step]


def _grow(rows: list[dict]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        bad = sum(r["bad"] for r in rows)
        if not bad or bad == len(rows):
            break
        before, best, chosen = math.log2(bad / len(rows)), 0.0, None
        for feature in FEATURES:
            for threshold in _thresholds(rows, feature):
                for above in (True, False):
                    held = [r["bad"] for r in rows if (r[feature] >= threshold) == above or r[feature] == threshold]
                    if p := sum(held):
                        gain = p * (math.log2(p / len(held)) - before)
                        if gain > best + 1e-12:
                            best, chosen = gain, Condition(feature, above, threshold)
        if chosen is None:
            break
        rule += (chosen,)
        rows = [r for r in rows if chosen.holds(r)]
    return rule


def _worth(rule: Rule, rows: list[dict]) -> float:
    held = [r["bad"] for r in rows if covers(rule, r)]
    return (sum(held) - (len(held) - sum(held))) / len(held) if held else -1.0


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The shortest beginning of the rule that is as sure as any on rows it was not grown on."""
    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (_worth(r, rows), -len(r)))


def learn(rows: list[dict]) -> list[Rule]:
    """An ordered list of rules for the rows that are `bad`; empty if none is sure enough."""
    left, rules = list(rows), []
    while len(rules) < MAX_RULES:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        if not any(r["bad"] for r in grow) or not any(r["bad"] for r in prune):
            break
        rule = _grow(grow)
        if not rule:
            break
        rule = _prune(rule, prune)
        held = [r["bad"] for r in prune if covers(rule, r)]
        if not held or sum(held) < PRECISION * len(held) or sum(held) < 3:
            break
        rules.append(rule)
        left = [r for r in left if not covers(rule, r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: False by the first rule that holds, else True."""
    columns, out = features(), None
    for rule in rules:
        held = rule[0].column(columns)
        for condition in rule[1:]:
            held &= condition.column(columns)
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled(df: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> list[dict]:
    """Features of at most `sample` keys of each label, chosen by a hash; of repeated keys the least text."""
    given = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label in (0, 1) and key is not null")
    given = given.groupBy("key").agg(F.min("label").alias("label"))
    chosen = [given.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(sample) for v in (0, 1)]
    # At most 2 x `sample` keys.
    picked = df.select(df[key].alias("key"), df[text].alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "key")
    # One row of each key, whatever the number of its rows.
    picked = picked.groupBy("key").agg(F.min("text").alias("text"))
    measured = statistics(picked, "text", "key")
    joined = measured.join(F.broadcast(chosen[0].union(chosen[1])), "key")
    rows = joined.where(~base_failed()).select(
        "key", (F.col("label") == 0).alias("bad"), *[c.alias(n) for n, c in features().items()]
    ).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["key"])]


def rules_for(df: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> list[Rule]:
    return learn(labelled(df, labels, text, key, label, sample))


def quality(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """Per row: key, statistics, base_failed, and kept by the base rules and the learned list.

    The list is learned from at most `sample` labelled rows of each label (1 stays, 0 goes) that
    pass the base rules; rows without a label, and labels without a row, take no part in it.
    Without rows of both labels the list is empty. NULL and empty texts fail the base rules.
    Repeated rows are judged each; an empty table gives no rows.
    """
    rules = rules_for(df, labels, text, key, label, sample)
    return statistics(df, text, key).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def filtered(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows, with their own columns, that `quality` keeps; judged within the scan."""
    rules = rules_for(df, labels, text, key, label, sample)
    return statistics(df, text, key, carry=True).where(~base_failed() & verdict(rules)).select("row.*")
