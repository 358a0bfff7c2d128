"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every signal is a DataFrame expression over the whole text; null counts as empty. Each rule
turns signals into a vote: 1 good, -1 bad, 0 abstains. The votes' patterns (at most
3 ^ number of rules, whatever the input) are counted by Spark. From those counts
expectation-maximisation estimates how often each rule votes which way on good and on bad
texts, and how many texts are good. It starts from the votes themselves (none against: good;
one: undecided; more: bad) and nothing holds its estimates back but one pseudo-count a cell.
A text is kept if its posterior probability of being good reaches one half and no base rule
fails, so one vote of a rule that errs often doesn't cost a text its place. Rules overlap on
purpose: two rules that see one fault in different ways tell it from a rule's own error.

Repeated rows and null ids are judged row by row; ties (a posterior of exactly one half) are
kept. On an empty table every posterior is one half. Very long texts are read whole. A signal
column of a clashing name is replaced; all other columns are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_symbol_words", "n_bare_words", "n_ends", "n_same_next")
_SPACE = r"[ \t-\r]"


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns SIGNALS (long). Narrow; no shuffle, no Python."""
    t = "__t"
    d = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("__w", F.array_remove(F.split(F.regexp_replace(t, r"[\t-\r]", " "), " "), ""))
    d = d.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    d = d.withColumn("__n", F.size("__w"))
    pair = lambda a, k: F.zip_with(a, F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    # runs of 2, 4 and 8 words; the last 7 of the result reach beyond the text and go
    for k, (a, b) in enumerate((("__w", "__h1"), ("__h1", "__h2"), ("__h2", "__h4"))):
        d = d.withColumn(b, F.when(F.col("__n") >= 8, pair(F.col(a), 1 << k)))
    d = d.withColumn("__h", F.when(F.col("__n") >= 8, F.slice("__h4", 1, F.greatest(F.col("__n") - 7, F.lit(1)))))
    d = d.withColumn("__rep", F.coalesce(F.size(F.array_distinct("__h")) < F.size("__h"), F.lit(False)))
    ordered = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.col("__rep"), ordered))
    n = F.size("__s")
    after = F.zip_with(F.slice("__s", 1, n - 1), F.slice("__s", 2, n - 1), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)))
    d = d.withColumn("__p", F.when(F.col("__rep"), F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))))
    m = F.size("__p")
    covered = F.aggregate(F.zip_with(F.slice("__p", 1, m - 1), F.slice("__p", 2, m - 1), lambda x, y: F.least(y - x, F.lit(8))), F.lit(8), lambda s, x: s + x)
    found = {
        "n_words": F.col("__n"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.col("__rep"), covered).otherwise(0),
        "n_lines": F.size("__l"),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", "")),
        "n_letters": F.length(t) - F.length(F.regexp_replace(t, r"[A-Za-z\x{80}-\x{10FFFF}]+", "")),
        "n_distinct": F.size(F.array_distinct("__w")),
        "n_symbol_words": F.size(F.filter("__w", lambda x: x.rlike("[#*$%&|<>]"))),
        "n_bare_words": F.size(F.filter("__w", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))),
        "n_ends": F.size(F.filter("__w", lambda x: x.rlike("[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)]?$"))),
        "n_same_next": F.size(F.filter(F.zip_with(F.slice("__w", 1, F.greatest(F.col("__n") - 1, F.lit(0))), F.slice("__w", 2, F.greatest(F.col("__n") - 1, F.lit(0))), lambda x, y: x == y), lambda x: x)),
    }
    keep = [c for c in docs.columns if c not in found]
    return d.select(*keep, *[c.cast("long").alias(k) for k, c in found.items()])


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


#: Rules: name, when bad, when good; otherwise the rule abstains.
RULES = (
    ("length", "n_words < 20", "n_words >= 40"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 13 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_words", "20 * n_symbol_words > n_words", "50 * n_symbol_words <= n_words"),
    ("bare_words", "5 * n_bare_words > n_words", "20 * n_bare_words <= n_words"),
    ("sentences", "n_words >= 80 and 80 * n_ends < n_words", "25 * n_ends >= n_words"),
    ("lines", "3 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words"),
    ("stutter", "10 * n_same_next > n_words", "50 * n_same_next <= n_words"),
    ("upper", "2 * n_upper > n_letters", "5 * n_upper <= n_letters and n_upper > 0"),
    ("letters", "10 * n_letters < 7 * word_chars", "100 * n_letters >= 85 * word_chars"),
    ("variety", "n_words >= 50 and 8 * n_distinct < least(n_words, 400)", "n_words >= 20 and 4 * n_distinct >= least(n_words, 400)"),
)


def votes() -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{name}") for name, bad, good in RULES]


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 500) -> dict:
    """Expectation-maximisation on vote patterns (rows of -1, 0, 1) that occur n times each.

    prior: the share of good texts. rate[c, i, v + 1]: how often rule i votes v on texts of
    class c (1 good, 0 bad). accuracy: of a rule's votes that don't abstain, the share that is right.
    """
    k = patterns.shape[1]
    if not len(patterns):
        return {"prior": 0.5, "rate": np.full((2, k, 3), 1 / 3), "accuracy": np.full(k, 0.5)}
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    against = (patterns == -1).sum(1)
    good = np.where(against == 0, 1.0, np.where(against == 1, 0.5, 0.0))
    last = None
    for _ in range(rounds):
        weight = np.stack([(1 - good) * n, good * n])
        seen = np.einsum("cp,piv->civ", weight, hot) + 1
        rate = seen / seen.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        z = np.log(prior / (1 - prior)) + np.einsum("piv,iv->p", hot, np.log(rate[1] / rate[0]))
        good = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if last is not None and np.abs(good - last).max() < 1e-9:
            break
        last = good
    right = prior * rate[1, :, 2] + (1 - prior) * rate[0, :, 0]
    wrong = prior * rate[1, :, 0] + (1 - prior) * rate[0, :, 2]
    return {"prior": float(prior), "rate": rate, "accuracy": right / (right + wrong)}


def fit(signalled: DataFrame) -> dict:
    """The estimate() of all rows' votes."""
    names = [f"v_{r[0]}" for r in RULES]
    table = signalled.select(*votes()).groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ^ len(RULES) rows
    table.sort(key=lambda r: tuple(r[c] for c in names))
    return estimate(np.array([[r[c] for c in names] for r in table], np.int64).reshape(-1, len(names)), np.array([r["n"] for r in table], float))


def judge(signalled: DataFrame, model: dict) -> DataFrame:
    """With columns base_failed, quality (posterior probability of good) and kept."""
    odds = np.log(model["rate"][1] / model["rate"][0])
    z = F.lit(float(np.log(model["prior"] / (1 - model["prior"]))))
    for vote, o in zip(votes(), odds, strict=True):
        z = z + F.when(vote == 1, float(o[2])).when(vote == -1, float(o[0])).otherwise(float(o[1]))
    d = signalled.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-z)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
