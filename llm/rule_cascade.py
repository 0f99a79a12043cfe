"""Quality rules as a short-circuit cascade, in DataFrame operations only.

On a sample each rule's cost (seconds a row) and selectivity (share of rows rejected) are measured. Rules run in the order of rejection per
cost, so that cheap rules that reject much come first, and a rule sees only what all before it have let pass. The order changes
the time, never the result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm._common import fresh, words_array

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Rows of the sample that costs are measured on. It bounds the estimate alone.
SAMPLE = 1000
#: How often a row of the sample is judged while a rule is timed.
TIMES = 20


@dataclass(frozen=True)
class Rule:
    """Rejects a row if ``rejects`` is true; null counts as false."""

    name: str
    rejects: Column


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)


def base_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``base_failed``; null text counts as empty. Columns of these names are replaced, all others stay.

    Repeated words are found by sorting a text's hashed 3-word windows, if two hashes are equal: equal neighbours, word for word, mark repeated windows, and
    the words they cover are counted once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, hashes, hashed, places, lines = fresh(docs, "words", "hashes", "hashed", "places", "lines")
    at = lambda i: F.get(F.col(words), i)
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    other = lambda k: F.get(F.col(hashed), k)

    def equal(x: Column, y: Column) -> Column:
        found = x["h"] == y["h"]
        for k in range(3):
            found = found & (at(x["i"] + k) == at(y["i"] + k))
        return found

    twice = F.transform(hashed, lambda x, k: F.when(equal(x, other(k - 1)) | equal(x, other(k + 1)), x["i"]))
    gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(places), k + 1) - p, F.lit(3))))
    out = docs.withColumn(words, words_array(text)).withColumn("n_words", n.cast("long"))
    out = out.withColumn(hashes, F.coalesce(windows, F.array().cast("array<bigint>")))
    out = out.withColumn(hashed, F.when(some, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    out = out.withColumn(places, F.sort_array(F.array_compact(twice)))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)).drop(words, hashes, hashed, places)
    out = out.withColumn("word_chars", F.length(F.translate(text, WHITE, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    out = out.withColumn(lines, _lines(text)).withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).drop(lines)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # A filter on a signal must not be pushed below, into the lambdas that made it: a generator stops that.
    own = [F.col(f"`{c}`") for c in out.columns if c not in SIGNALS]
    return out.select(*own, F.inline(F.array(F.struct(*SIGNALS))))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules on the base signals and the text, beyond the base ones; cautious, so that ordinary prose passes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("symbols", F.col("n_symbols") * 4 > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") > 25 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
        Rule("dup_lines", (F.col("n_dup_lines") >= 4) & (F.col("n_dup_lines") * 2 > lines)),
        Rule("shouting", upper * 2 > letters),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
    ]


@dataclass(frozen=True)
class Measured:
    """A rule's order in the cascade comes from these figures of the sample."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure(rows: DataFrame, rules: list[Rule], sample: int = SAMPLE, clock=time.perf_counter) -> list[Measured]:
    """Cost and selectivity of each rule on at most ``sample`` rows, best rejection per cost first.

    The sample is read once into Spark's cache, and each row is judged `TIMES` times over, so that a rule's time stands out of its job's. A rule's cost is
    the time of its aggregate less that of an empty one, and no less than a fiftieth of this, below which times say nothing.
    """
    part = rows.limit(sample).cache()
    try:
        total = part.count()
        (again,) = fresh(part, "again")
        often = part.withColumn(again, F.explode(F.sequence(F.lit(1), F.lit(TIMES))))
        bare = Rule("", F.lit(False))
        out = []
        for k, rule in enumerate([bare, bare, *rules]):  # the first run warms up, the second is the empty one
            began = clock()
            n = often.agg(F.count_if(F.coalesce(rule.rejects, F.lit(False)) & (F.col(again) > 0))).first()[0]
            out.append(Measured(rule, clock() - began, n / max(1, total * TIMES)))
            if k == 1:
                empty = out[-1].seconds
        return sorted((Measured(m.rule, max(m.seconds - empty, empty / 50), m.rejected) for m in out[2:]), key=lambda m: (-m.rank, m.rule.name))
    finally:
        part.unpersist()


def cascade(rules: list[Rule], base_failed: Column) -> Column:
    """The name of the first rule that rejects a row, ``base`` before all; null if none does. Later rules aren't evaluated."""
    found = F.when(base_failed, "base")
    for rule in rules:
        found = found.when(F.coalesce(rule.rejects, F.lit(False)), rule.name)
    return found


def judge(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows with the base signals, ``base_failed`` and ``kept``: base passed and no rule of the cascade rejects.

    Null and empty texts have no words and so fail the base. Repeated rows and null ids are judged each on its own; an empty table gives
    no rows. Columns of ``docs`` stay, but for those that bear the signals' names or ``kept``, which are replaced. The order of the rules is estimated on about ``sample``
    random rows, whose signals alone are computed for it.
    """
    rules = default_rules(text_col) if rules is None else rules
    n = docs.count()
    drawn = docs if n <= 2 * sample else docs.sample(1.2 * sample / n, 11)
    ordered = [m.rule for m in measure(base_signals(drawn, text_col), rules, sample)]
    return base_signals(docs, text_col).withColumn("kept", cascade(ordered, F.col("base_failed")).isNull())
