"""Quality rules as a short-circuit cascade, with DataFrame operations only.

Each rule's cost (the best of a few timings of it alone on a sample) and selectivity (share of the sample it
rejects) are measured; rules then run in order of rejection per cost, and a text that one
rejects is not looked at by the next (CASE evaluates lazily).  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_clashing, stage

# What separates words, what counts as a symbol, the window of repeats.
_BLANKS, _WORD, SYMBOLS, WINDOW = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]", 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a lambda would compute an outer expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(_WORD))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _repeats(w: Column) -> Column:
    """Words inside windows that occur twice or more, of an array of words; windows compare by 64-bit hash."""
    of_words = F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            value = lambda j: F.get(p, j)["h"]
            twice = F.transform(p, lambda x, j: F.when((x["h"] == value(j - 1)) | (x["h"] == value(j + 1)), x["i"]))
            return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(let(ordered, positions), start, step, lambda a: a["n"])

    found = let(let(of_words, windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > WINDOW, found).otherwise(0)


def n_repeat_words(text: Column) -> Column:
    return let(words(text), _repeats).cast("long")


def n_letters(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]")).cast("long")


def n_upper(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Z]")).cast("long")


METRICS: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters, n_upper)}


@dataclass(frozen=True)
class Rule:
    """rejects: the condition, given the metrics of `needs` in that order."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]

    def on(self, metric: Callable[[str], Column]) -> Column:
        """The rule's condition on a row; metric gives a metric's column."""
        return self.rejects(*[metric(n) for n in self.needs])


#: The first two are the base rules.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
    Rule("symbols", ("n_symbols", "word_chars"), lambda s, c: 100 * s > 10 * c),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d > 0) & (100 * d > 30 * n)),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 40 * n),
    Rule("shouting", ("n_upper", "n_letters"), lambda u, n: 2 * u > n),
)
BASE = ("few_words", "repeats")


#: Metrics that `measured` gives for every row; a rule of these alone costs next to nothing there.
GIVEN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _given(df: DataFrame, text: Column) -> DataFrame:
    """df's columns and the metrics of GIVEN; words and lines are split once."""
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words")))
    names = [F.col(f"`{c}`") for c in df.columns]
    found = df.select(*names, of_words.alias("__w"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"))
    return found.select(*names, *[F.col(f"__w.{m}") if m not in ("n_symbols", "n_dup_lines") else F.col(m) for m in GIVEN])


def _lazily(text: Column, given: tuple[str, ...]) -> Callable[[str], Column]:
    """Metrics by name: columns where given, else expressions of the text, to be used inside CASE."""
    return lambda n: F.col(n) if n in given else METRICS[n](text)


def _sample(df: DataFrame, text: str, rows: int) -> DataFrame:
    """Rows drawn one by one, whatever they hold, about `rows` and never more than twice as many."""
    fraction = min(1.0, rows / max(1, df.count()))
    return stage(df.select(F.col(f"`{text}`").alias("text")).where(F.rand(5) < fraction).limit(2 * rows), "sample")


def fit_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, given: tuple[str, ...] = (), passed: Callable[[Callable], Column] | None = None, timings: int = 3) -> tuple[Rule, ...]:
    """rules in order of rejection per cost on a sample of about `sample_rows` rows, at most twice as many.

    Metrics of `given` are there already and cost nothing; `passed`, from metrics, tells the rows that reach the rules.
    An empty table leaves the rules as they are.
    """
    sample = _sample(df, text, sample_rows)
    metric = _lazily(F.col("text"), given)
    if given:
        sample = _given(sample, F.col("text"))
    if passed is not None:
        sample = sample.where(passed(metric))
    sample = stage(sample.coalesce(1), "sample").cache()  # one task, so that time is the task's
    try:
        if not sample.count():
            return rules

        def timed(*columns: Column):
            best, row = float("inf"), None
            for _ in range(timings):
                began = time.perf_counter()
                row = sample.agg(F.count("*"), *columns).first()
                best = min(best, time.perf_counter() - began)
            return best, row

        idle, _ = timed(F.max(F.length("text")))
        scored = []
        for place, rule in enumerate(rules):
            seconds, row = timed(F.count_if(rule.on(metric)))
            rate = (row[1] + 0.5) / (row[0] + 1)
            scored.append((-rate / max(1e-3, seconds - idle), place, rule))
    finally:
        sample.unpersist()
    return tuple(r for *_, r in sorted(scored, key=lambda x: x[:2]))


def verdict(rules: tuple[Rule, ...], metric: Callable[[str], Column], failed: Column | None = None) -> Column:
    """True if no rule rejects; rules after the first that does, or after `failed`, are not evaluated."""
    out = F if failed is None else F.when(failed, False)
    for rule in rules:
        out = out.when(rule.on(metric), False)
    return F.lit(True) if out is F else out.otherwise(True)


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df without rejected rows.  Each text costs only the rules up to the one that rejects it.

    A null text is empty.  Texts are taken whole; repeated rows fare alike; other columns pass through; an empty table stays empty.
    """
    return df.where(verdict(fit_order(df, text, rules), _lazily(F.col(f"`{text}`"), ())))


def measured(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df's columns, then the metrics of GIVEN, base_failed and kept (false where base_failed); a null text is empty and fails.

    The base rules come first, as every row has their metrics; the others follow in measured order, and the metrics that only they need
    are taken only of texts that reach them.
    Texts are taken whole, of any length; repeated rows come out alike; ties of order go by the rules' own order and change no result.
    Columns named as outputs are replaced; an empty table gives no rows.
    """
    base = drop_clashing(df, [*GIVEN, "base_failed", "kept"])
    extra = tuple(r for r in rules if r.name not in BASE)
    fails = lambda metric: (metric("n_words") < 10) | (100 * metric("n_repeat_words") > 20 * metric("n_words"))
    order = fit_order(df, text, extra, given=GIVEN, passed=lambda metric: ~fails(metric)) if extra else ()
    out = _given(base, F.col(f"`{text}`")).withColumn("base_failed", fails(F.col))
    return out.withColumn("kept", verdict(order, _lazily(F.col(f"`{text}`"), GIVEN), F.col("base_failed")))
