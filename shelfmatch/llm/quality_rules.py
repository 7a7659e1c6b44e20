"""Quality rules: text statistics and learned decision lists (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm.common import BLANKS, let, saved, table, text_or_empty, words

#: What counts as a symbol, and the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: a count, or its share of another.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"), "mark_share": ("n_marks", "word_chars"),
    "capital_share": ("n_capitals", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"), "n_words": ("n_words", None),
}


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(parts: Column) -> Column:
    """Words that lie in a window of five words found twice or more in ``parts``, the first included.

    Windows are compared by a 64-bit hash inside one text. Sorting puts equal windows side by side;
    their places, in order, each add the words that the place before has not covered.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(pairs, lambda s: F.transform(
            s, lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])
        ))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            F.sort_array(F.filter(places, lambda p: p.isNotNull())), start,
            lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        )["n"]

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(parts) - WINDOW), lambda i: F.xxhash64(*[parts[i + k] for k in range(WINDOW)])
    )
    return F.when(F.size(parts) <= WINDOW, 0).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    )


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and ``__stats``: counts over the whole text; null counts as empty.

    One generated row per text, so that a later filter on the counts does not compute them again.
    """
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, BLANKS) > 0)

    def counts(value: Column) -> Column:
        return let(F.struct(words(value).alias("w"), lines.alias("l")), lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            _without(value, BLANKS).cast("long").alias("word_chars"),
            (F.length(value) - _without(value, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            repeated_words(x["w"]).cast("long").alias("n_repeat_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.length(value) - _without(value, "!?")).cast("long").alias("n_marks"),
            (F.length(value) - _without(value, CAPITALS)).cast("long").alias("n_capitals"),
        ))

    return df.select("*", F.explode(F.array(counts(text))).alias("__stats"))


def base_failed(stats: str = "__stats") -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < LEAST_WORDS) | (F.lit(100) * F.col(f"{stats}.n_repeat_words") > MOST_REPEATED_PERCENT * n)


def features(df: DataFrame, stats: str = "__stats") -> DataFrame:
    def value(count: str, of: str | None) -> Column:
        part = F.col(f"{stats}.{count}").cast("double")
        return part / F.greatest(F.lit(1), F.col(f"{stats}.{of}")) if of else part

    return df.withColumns({f"__f_{name}": value(*parts) for name, parts in FEATURES.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"__f_{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in conditions], F.lit(True))


def learn(
    labelled: DataFrame, bad: str = "__bad", split: str = "__prune", bins: int = 24, most_rules: int = 8,
    most_conditions: int = 3, least_covered: int = 5, least_precision: float = 0.9,
) -> list[Rule]:
    """Sequential covering: rules for bad rows, each a conjunction of thresholds, in the order found.

    Thresholds are quantiles of the labelled rows. A rule grows by the condition with the best
    information gain on the growing rows that no earlier rule covers, loses its last conditions if
    that raises its worth on the pruning rows, and is taken if its precision holds on both. Only
    counts per feature and threshold reach the driver: features x ``bins`` x 2 numbers a step.
    Without labels, or with labels of one kind, there are no rules.
    """
    names = list(FEATURES)
    cuts_of = labelled.agg(*[
        F.percentile_approx(f"__f_{n}", [(i + 0.5) / bins for i in range(bins)], 100_000).alias(n) for n in names
    ]).first()
    cuts = {n: sorted(set(cuts_of[n] or [])) for n in names}
    tests = [Condition(n, above, t) for n in names for t in cuts[n] for above in (True, False)]
    if not tests:
        return []
    rows, rules = labelled, []

    def counted(rows: DataFrame, options: list[Rule]) -> list[tuple[int, int]]:
        sums = rows.groupBy(bad).agg(*[F.count_if(_all(o)).alias(f"c{i}") for i, o in enumerate(options)]).collect()
        by = {r[bad]: r[1:] for r in sums}
        none = (0,) * len(options)
        return list(zip(by.get(1, none), by.get(0, none)))

    def by_threshold(rows: DataFrame) -> list[tuple[int, int]]:
        """(bad, good) of every test, from one histogram."""
        cells = F.array(*[
            F.struct(F.lit(i).alias("f"), reduce(
                lambda a, t: a + F.when(F.col(f"__f_{n}") > t, 1).otherwise(0), cuts[n], F.lit(0)
            ).alias("b")) for i, n in enumerate(names)
        ])
        cell = rows.select(bad, F.explode(cells).alias("__c")).groupBy(bad, "__c.f", "__c.b").count().collect()
        found = {(r[bad], r["f"], r["b"]): r["count"] for r in cell}
        out = []
        for test in tests:
            f, at = names.index(test.feature), cuts[test.feature].index(test.threshold)
            bands = range(at + 1, len(cuts[test.feature]) + 1) if test.above else range(at + 1)
            out.append(tuple(sum(found.get((kind, f, b), 0) for b in bands) for kind in (1, 0)))
        return out

    def worth(p: int, n: int) -> float:
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < most_rules:
        grow, rule = rows.where(~F.col(split)), ()
        p0, n0 = counted(grow, [()])[0]
        while len(rule) < most_conditions and p0 and n0:
            found = by_threshold(grow.where(_all(rule)))
            gains = [
                (p * (_bits(p0, n0) - _bits(p, n)), -i) for i, (p, n) in enumerate(found) if p >= least_covered
            ]
            if not gains or max(gains)[0] <= 1e-9:
                break
            at = -max(gains)[1]
            rule, (p0, n0) = (*rule, _centred(grow.where(_all(rule)), tests[at])), found[at]
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        held = counted(rows.where(F.col(split)), prefixes)
        at = max(range(len(rule)), key=lambda i: (worth(*held[i]), -i))
        grown = counted(grow, [prefixes[at]])[0]
        p, n = grown[0] + held[at][0], grown[1] + held[at][1]
        if p < least_covered or p < least_precision * (p + n):
            break
        rules.append(prefixes[at])
        rows = rows.where(~_all(prefixes[at]))
    return rules


def _centred(rows: DataFrame, test: Condition) -> Condition:
    """The test with its threshold halfway between the values on either side, clear of both."""
    value = F.col(f"__f_{test.feature}")
    low, high = rows.agg(
        F.max(F.when(value <= test.threshold, value)), F.min(F.when(value > test.threshold, value))
    ).first()
    return test if low is None or high is None else Condition(test.feature, test.above, (low + high) / 2)


def _bits(p: int, n: int) -> float:
    from math import log2

    return log2((p + n) / p)


def verdict(rules: list[Rule]) -> Column:
    """The ordered decision list as one conditional expression: number of the first rule that rejects."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(_all(rule), F.lit(i + 1))
    return out


def learn_from(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_labelled: int = 20_000,
) -> list[Rule]:
    """Rules from at most ``most_labelled`` labelled documents, chosen by the hash of their identifier.

    The bound makes the identifiers (8 bytes each) fit to be sent to every task, so texts are not
    moved. Rows that fail the base rule are not learned from. Null labels and identifiers, and
    identifiers with both labels, are left out.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).dropna()
        .groupBy("__id").agg(F.min("__label").alias("__low"), F.max("__label").alias("__label"))
        .where("__low = __label").orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)
        .select("__id", (F.col("__label") == 0).cast("int").alias("__bad"))
    )
    ours = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    stats = with_statistics(ours.join(F.broadcast(chosen), "__id"), "__text").where(~base_failed())
    rows = features(stats).select(
        "__bad", (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).alias("__prune"), *[f"__f_{n}" for n in FEATURES]
    )
    return learn(saved(rows))


def judged(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """All columns with ``__stats``, ``__base_failed``, ``__rule`` (null: none) and ``__kept``.

    Columns of these four names are replaced; every other name may occur. Null and blank texts fail the
    base rule; repeated rows get the same verdict each; an empty table gives none.
    """
    rows, own = _judged(df, rules, text_col)
    added = ["__stats", "__base_failed", "__rule", "__kept"]
    return rows.select(*[v for c, v in own if c not in added], *added)


def _judged(df: DataFrame, rules: list[Rule], text_col: str) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Verdicts beside columns renamed by place, and each given name with its renamed column."""
    names = [f"own{i}" for i in range(len(df.columns))]
    rows = features(with_statistics(df.toDF(*names), names[df.columns.index(text_col)]))
    rows = rows.withColumns({"__base_failed": base_failed(), "__rule": verdict(rules)})
    kept = ~F.col("__base_failed") & F.col("__rule").isNull()
    return rows.withColumn("__kept", kept), [(c, F.col(n).alias(c)) for c, n in zip(df.columns, names)]


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per document: the statistics, whether the base rule fails, and the verdict.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rule`` (number of the learned rule that rejects, null if none). Null and blank texts have no
    words and fail the base rule. Identifiers are not used but for labels; they may be null or
    repeat. Other columns are not read.
    """
    rules = learn_from(docs, labels, id_col, text_col, label_col)
    rows = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    return rows.select(
        "doc_id", *[F.col(f"__stats.{n}").alias(n) for n in BASE], F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"), F.col("__rule").alias("rule"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a learned rule rejects.

    All columns stay as they are, whatever their names. Rows with a null or blank text go, since they fail
    the base rule; identifiers may be null or repeat; repeated rows stay or go together; an empty
    table gives an empty one, and without usable labels the base rule alone decides.
    """
    rows, own = _judged(docs, learn_from(docs, labels, id_col, text_col, label_col), text_col)
    return rows.where("__kept").select(*[v for _, v in own])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
