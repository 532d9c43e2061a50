"""Quality rules: a decision list over text statistics, learned by sequential covering.

Only DataFrame functions are used. Statistics of every text are computed inside the row; the rules are
grown and pruned from counts that Spark aggregates over the labelled rows, and are emitted as one ordered
``when`` chain.

Defined results: a null text has no words, so all its counts are 0 and base_failed is true. Empty texts are
treated like null. Repeated rows each get their own result. Labels that are null, or whose text is missing,
are not learned from; without labelled rows of both classes the list is empty and the verdict is ``good``.
Columns of the input whose names clash with the statistics are left out of the result unless asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once, saved, words_by_space

#: Statistics that conditions may test.
FEATURES = (
    "symbols_per_word",
    "repeat_share",
    "dup_line_share",
    "mean_word_chars",
    "upper_share",
    "digit_share",
    "mark_share",
    "short_word_share",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)
    precision: float = 0.0
    covered: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds word counts and shares to each row; ``n_repeat_words`` counts words inside 3-word windows that occur twice or more.

    Where two windows of a text share a 64-bit hash, its windows are sorted by hash and position inside the row; a window equals a neighbour in that
    order if it is repeated. The words covered are those not covered by the repeated window before.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0)
    out = docs.withColumns({"_words": computed_once(words_by_space(F.col(text))), "_lines": computed_once(lines)})
    w, n_win = F.col("_words"), F.greatest(F.size("_words") - 2, F.lit(0))
    triples = F.arrays_zip(F.slice(w, 1, n_win).alias("a"), F.slice(w, 2, n_win).alias("b"), F.slice(w, 3, n_win).alias("c"))
    out = out.withColumn("_hash", computed_once(F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))))
    sorted_windows = F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    out = out.withColumn("_win", computed_once(F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), sorted_windows)))
    win, n_next = F.col("_win"), F.size("_win") - 1
    twins = F.filter(F.arrays_zip(F.slice(win, 1, n_next).alias("a"), F.slice(win, 2, n_next).alias("b")), lambda x: x["a"].h == x["b"].h)
    positions = F.array_union(F.transform(twins, lambda x: x["a"].p), F.transform(twins, lambda x: x["b"].p))
    covered = F.coalesce(
        F.aggregate(
            F.sort_array(positions),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(3))).cast("bigint").alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        ),
        F.lit(0).cast("bigint"),
    )
    squeezed = F.translate(body, " \t\n\u000b\f\r", "")
    n = F.col("n_words")
    per_word = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    per_char = lambda x: F.when(F.col("word_chars") > 0, x / F.col("word_chars")).otherwise(F.lit(0.0))
    out = out.withColumns(
        {
            "n_words": computed_once(F.size(w).cast("bigint")),
            "word_chars": F.length(squeezed).cast("bigint"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": computed_once(covered),
            "_n_lines": F.size("_lines"),
            "_upper": F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "_digits": F.length(F.translate(body, "0123456789", "")),
            "_marks": F.length(F.translate(body, "!?|=~_^@", "")),
            "_short": F.size(F.filter(w, lambda x: F.length(x) <= 1)),
            "_chars": F.length(body),
        }
    )
    out = out.withColumns(
        {
            "symbols_per_word": per_word(F.col("n_symbols")),
            "repeat_share": per_word(F.col("n_repeat_words")),
            "dup_line_share": F.when(F.col("_n_lines") > 0, F.col("n_dup_lines") / F.col("_n_lines")).otherwise(F.lit(0.0)),
            "mean_word_chars": per_word(F.col("word_chars")),
            "upper_share": per_char(F.col("_chars") - F.col("_upper")),
            "digit_share": per_char(F.col("_chars") - F.col("_digits")),
            "mark_share": per_char(F.col("_chars") - F.col("_marks")),
            "short_word_share": per_word(F.col("_short")),
        }
    )
    return out.drop("_words", "_lines", "_hash", "_win", "_n_lines", "_upper", "_digits", "_marks", "_short", "_chars")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def learn_rules(
    labelled: DataFrame,
    bad: Column,
    features=FEATURES,
    *,
    max_rules: int = 8,
    max_conditions: int = 3,
    quantiles: int = 16,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the third, take its rows away, go on.

    ``labelled`` has the features and whatever ``bad`` reads; it is bounded by the caller and is saved once, with the
    number of thresholds below each value. Thresholds are quantiles of either class. A growing step counts good and bad
    rows by (feature, thresholds below), so only counts reach the driver, and takes the condition with the largest gain
    in bad rows times log precision. Pruning keeps the prefix of conditions whose (bad - good) / (bad + good) on the
    pruning rows is highest. A rule must keep ``min_precision`` and ``min_covered`` rows over both parts.
    """
    rows = saved(
        labelled.select(*features, bad.cast("boolean").alias("_bad"))
        .where(F.col("_bad").isNotNull())
        .withColumn("_prune", F.pmod(F.xxhash64(*features), F.lit(3)) == 0)
    )
    shares = [i / quantiles for i in range(1, quantiles)] + [0.005, 0.02, 0.98, 0.995, 1.0]
    cuts = rows.groupBy("_bad").agg(*[F.percentile_approx(f, shares, 1000).alias(f) for f in features]).collect()
    if len(cuts) < 2:
        return []
    at = {f: sorted({float(t) for row in cuts for t in row[f]}) for f in features}
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, at[f])), lambda t: t < F.col(f)))
    left = saved(rows.withColumn("_bins", F.array(*[F.struct(F.lit(f).alias("f"), below(f).alias("bin")) for f in features])))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = Rule()
        while len(rule.conditions) < max_conditions and (best := _best_condition(left, rule, at)):
            rule.conditions.append(best)
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
        counts = {}
        for i, r in enumerate(prefixes):
            counts[f"pb{i}"] = F.count_if(F.col("_prune") & F.col("_bad") & r.column())
            counts[f"pg{i}"] = F.count_if(F.col("_prune") & ~F.col("_bad") & r.column())
            counts[f"b{i}"] = F.count_if(F.col("_bad") & r.column())
            counts[f"n{i}"] = F.count_if(r.column())
        got = left.agg(*[c.alias(k) for k, c in counts.items()]).first()
        worth = [(got[f"pb{i}"] - got[f"pg{i}"]) / max(1, got[f"pb{i}"] + got[f"pg{i}"]) for i in range(len(prefixes))]
        k = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        chosen = prefixes[k]
        chosen.covered, chosen.precision = got[f"n{k}"], got[f"b{k}"] / max(1, got[f"n{k}"])
        if chosen.precision < min_precision or chosen.covered < min_covered:
            break
        rules.append(chosen)
        left = left.where(~chosen.column())
    return rules


def _best_condition(left: DataFrame, rule: Rule, at: dict[str, list[float]]) -> Condition | None:
    """The condition that adds the most to a rule on the growing rows, or None if none adds anything."""
    grow = left.where(~F.col("_prune") & rule.column())
    got = grow.select("_bad", F.explode("_bins").alias("x")).groupBy("x.f", "x.bin").agg(F.count_if("_bad").alias("b"), F.count_if(~F.col("_bad")).alias("g")).collect()
    best, most = None, 0.0
    for f in at:
        by = {r["bin"]: (r["b"], r["g"]) for r in got if r["f"] == f}
        b, g = (sum(x[i] for x in by.values()) for i in (0, 1))
        if not b or not g:
            return None
        for j, t in enumerate(at[f]):
            over = [sum(x[i] for k, x in by.items() if k > j) for i in (0, 1)]
            for above, (nb, ng) in ((True, over), (False, (b - over[0], g - over[1]))):
                gain = nb * (math.log((nb + 1) / (nb + ng + 2)) - math.log((b + 1) / (b + g + 2)))
                if gain > most + 1e-12:
                    best, most = Condition(f, above, t), gain
    return best


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """(number of the first rule that fires or null, its text or null) as ordered conditional expressions."""
    number, said = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, r in reversed(list(enumerate(rules))):
        number = F.when(r.column(), F.lit(i + 1)).otherwise(number)
        said = F.when(r.column(), F.lit(str(r))).otherwise(said)
    return number, said


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, max_labelled: int, seed: int) -> DataFrame:
    """At most ``max_labelled`` labelled rows of ``docs`` (the smallest by hash), one label a key, joined to their texts.

    The labels are few beside the texts: their keys, a bounded number, are broadcast, so the texts aren't shuffled.
    """
    few = (
        labels.where(F.col(key).isNotNull())
        .groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in labels.columns if c != key])).alias("_label"))
        .orderBy(F.xxhash64(F.lit(seed), key), key).limit(max_labelled)
    )
    return docs.join(F.broadcast(saved(few)), key)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_labelled: int = 8000,
    seed: int = 42,
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, list[Rule]]:
    """Scores every row of ``docs`` with rules learned from at most ``max_labelled`` labelled rows (a bounded, documented sample).

    Returns the rows (key, ``keep``, statistics, base_failed, rule, rule_text, kept) and the rules. Rules are learned on
    rows that pass the base checks, for those are the rows they decide.
    """
    docs = docs.select(key, text, *keep)
    sample = with_statistics(labelled_rows(docs.select(key, text), labels.select(key, label), key, max_labelled, seed), text)
    rules = learn_rules(sample.where(~base_failed()), F.col(f"_label.{label}") == 0)
    number, said = rule_columns(rules)
    out = with_statistics(docs, text).withColumn("base_failed", base_failed()).withColumns({"rule": number, "rule_text": said})
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(key, *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "rule_text", "kept"), rules
