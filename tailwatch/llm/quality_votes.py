"""Quality by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Expectation-maximisation over the counts of vote patterns
estimates how often each rule gives each vote on good and on bad texts, and so its accuracy; a text is kept when its
posterior probability of being good reaches one half. There are at most 3 to the number of rules patterns, however many
texts, so a round of the estimation reads a table of bounded size.

Defined results: null and blank texts have no words, fail the base rule and are dropped; equal rows get equal
verdicts; an empty table gives an empty one. Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import hashed, with_window_hashes, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent short words of the corpus languages; running prose is full of them.
FREQUENT = (
    "the and of to in a is that for was on with as are at by be this from an or it "
    "der die das und in den von zu mit ein eine ist im des auf für als dem nicht "
    "le la les de des et un une en du que est dans pour pas par au qui sur "
    "el la los las de y que en un una del por con se para es al como"
).split()


def measures(df: DataFrame, text: str) -> DataFrame:
    """Adds the counts that rules read. Each array is computed in a projection of its own, once.

    Repeated words: 8-word windows are compared by 64-bit hashes. Sorting the hashes shows whether any occurs twice;
    only then are positions sorted beside them, and the words under repeated windows counted as a union of intervals.
    """
    blank = r"[^\x20\x09-\x0D]"
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(blank)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long"),
        "n_marks": F.length(F.regexp_replace("_t", r"[^!?]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": hashed(F.col("_w")),
        "n_frequent": F.size(F.filter("_w", lambda w: w.isin(FREQUENT))).cast("long"),
    })
    df = with_window_hashes(df.withColumn("n_distinct", F.size(F.array_distinct("_h")).cast("long")), "_h", WINDOW, "_h8")
    df = df.withColumn("_any", F.size("_h8") > F.size(F.array_distinct("_h8")))
    spots = F.when(F.col("_any"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", spots)
    twice = F.filter(
        F.transform("_s", lambda x, k: F.when(
            (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull())
    df = df.withColumn("_p", F.when(F.col("_any"), F.sort_array(twice)))
    step = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("_any"), covered).otherwise(F.lit(0).cast("long")))
    return df.drop("_t", "_w", "_lines", "_h", "_h8", "_any", "_s", "_p")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def votes() -> dict[str, Column]:
    """The rules. Shares are per word or per character; short texts abstain where a share means little."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    per_word = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    enough, again = n >= 20, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": vote(per_word("n_symbols") <= 0.05, per_word("n_symbols") > 0.25),
        "capitals": vote(F.col("n_capitals") / chars <= 0.15, F.col("n_capitals") / chars > 0.5),
        "marks": vote(per_word("n_marks") <= 0.1, per_word("n_marks") > 0.5),
        "frequent": vote(enough & (per_word("n_frequent") >= 0.08), enough & (per_word("n_frequent") < 0.02)),
        "repeats": vote(enough & (per_word("n_repeat_words") <= 0.1), per_word("n_repeat_words") > 0.2),
        "lines": vote((F.col("n_lines") >= 3) & (again <= 0.1), (F.col("n_lines") >= 3) & (again > 0.5)),
        "variety": vote(enough & (per_word("n_distinct") >= 0.2), enough & (per_word("n_distinct") < 0.05)),
        "word_length": vote((per_word("word_chars") >= 3) & (per_word("word_chars") <= 10), (per_word("word_chars") < 2) | (per_word("word_chars") > 14)),
    }


RULES = tuple("symbols capitals marks frequent repeats lines variety word_length".split())
#: Dirichlet prior of a rule's votes (bad, abstain, good) on good and on bad texts. It names the two classes and steadies
#: rules that hardly vote. Its weight is a share of all texts, so that it acts alike at every size.
PRIOR = {1: (0.01, 0.19, 0.80), 0: (0.25, 0.20, 0.55)}
PRIOR_SHARE, PRIOR_GOOD = 0.05, 0.9


def log_odds(model: dict) -> Column:
    """Log posterior odds of good against bad: the prior's plus, for each rule, those of the vote it cast."""
    terms = F.zip_with("votes", F.lit(model["logs"]), lambda v, t: F.get(t, v + 1))
    return F.aggregate(terms, F.lit(model["prior"]), lambda s, x: s + x)


def posterior(model: dict) -> Column:
    return 1 / (1 + F.exp(-log_odds(model)))


def _model(good: float, tables: list[dict]) -> dict:
    logs = [[math.log(g / b) for g, b in zip(t[1], t[0], strict=True)] for t in tables]
    return {"prior": math.log(good / (1 - good)), "logs": logs, "tables": tables}


def fit(patterns: DataFrame, rules: int = len(RULES), rounds: int = 20) -> dict:
    """Estimate the model from a stored table of vote patterns and their counts _n. A round reads that table and
    returns three rows a rule."""
    model = _model(PRIOR_GOOD, [PRIOR] * rules)
    for _ in range(rounds):
        shared = patterns.select("_n", posterior(model).alias("_p"), F.posexplode("votes").alias("_rule", "_vote"))
        rows = shared.groupBy("_rule", "_vote").agg(F.sum(F.col("_n") * F.col("_p")).alias("g"), F.sum(F.col("_n") * (1 - F.col("_p"))).alias("b")).collect()
        got = {(r["_rule"], r["_vote"]): (r["b"], r["g"]) for r in rows}
        size = [sum(v[c] for (rule, _), v in got.items() if rule == 0) for c in (0, 1)]
        extra = PRIOR_SHARE * sum(size)
        if not extra:
            break
        tables = [{c: tuple((got.get((j, v), (0.0, 0.0))[c] + extra * PRIOR[c][v + 1]) / (size[c] + extra) for v in (-1, 0, 1)) for c in (0, 1)} for j in range(rules)]
        model = _model((size[1] + PRIOR_GOOD * extra) / (sum(size) + extra), tables)
    return model


def accuracies(model: dict) -> dict[str, float]:
    """Per rule, the estimated probability that a vote, when cast, names the right class."""
    good = 1 / (1 + math.exp(-model["prior"]))
    out = {}
    for rule, t in zip(RULES, model["tables"], strict=False):
        right = good * t[1][2] + (1 - good) * t[0][0]
        out[rule] = right / (right + good * t[1][0] + (1 - good) * t[0][2])
    return out


def base_failed() -> Column:
    """Too short, or over 30 in 100 words inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(df: DataFrame) -> DataFrame:
    """The rules' votes, in the order of RULES, and base_failed beside the measures."""
    cast = votes()
    return df.withColumns({"votes": F.array(*[cast[r] for r in RULES]), "base_failed": base_failed()})


def pattern_counts(rows: DataFrame) -> DataFrame:
    """Texts that fail the base rule are dropped whatever the vote, so they teach nothing."""
    return rows.where(~F.col("base_failed")).groupBy("votes").agg(F.count("*").alias("_n"))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: measures, votes, base_failed, posterior and kept."""
    rows = pin(judged(measures(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").drop("_text")))
    model = fit(pin(pattern_counts(rows)))
    rows = rows.withColumn("posterior", posterior(model))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. Two passes over the texts and no join: the model is a handful of numbers.

    The row travels beside the measures as one value. The row number keeps the optimizer from moving the filter below
    the measures, where each use of an array would compute it again.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    model = fit(pin(pattern_counts(pin(judged(measures(rows.select("_text"), "_text")).select("votes", "base_failed")))))
    out = judged(measures(rows, "_text")).withColumn("_at", F.monotonically_increasing_id())
    return out.where(~F.col("base_failed") & (posterior(model) >= 0.5) & (F.col("_at") >= 0)).select("_row.*")
