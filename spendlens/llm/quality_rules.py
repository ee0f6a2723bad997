"""Quality rules as weak supervision, with DataFrame functions alone.

Each rule votes good (1), bad (0) or abstains (-1).  Expectation-maximisation over
the table of distinct vote patterns (at most 3^8 rows, made by a partial aggregate)
estimates how often each rule is right for good and for bad documents; the posterior
probability of "good" replaces all-must-pass filtering.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, texts, written

SPACES = r"[\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
ROUNDS = 12
#: Priors, weighted as a share of the rows, and bounds: they fix which class is "good".  Good
#: documents hardly ever get a bad vote; a bad one has one fault, seldom all of them.
PRIOR_SHARE, PRIOR_GOOD, PRIOR_RIGHT_GOOD, PRIOR_RIGHT_BAD = 0.02, 0.9, 0.999, 0.3
LEAST_RIGHT_GOOD, LEAST_RIGHT_BAD, MOST_RIGHT_BAD = 0.998, 0.02, 0.3
RULES = ("symbols", "word_length", "repeats", "lines", "capitals", "variety", "length", "digits")


def counts(docs: DataFrame) -> DataFrame:
    """Add the counts of each whole text (NULL counts as empty): n_words, word_chars,
    n_symbols, n_lines, n_dup_lines, n_repeat_words, and what the rules look at."""
    t = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    one = docs.withColumns({
        "_words": F.filter(F.split(t, f"{SPACES}+"), lambda x: x != ""),
        "_lines": F.filter(F.split(t, "\n"), has_word),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "_digits": F.regexp_count(t, F.lit(r"[0-9]")),
    })
    n = F.size("_words")
    two = one.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_kinds": F.size(F.array_distinct("_words")),
        "_run1": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_lines", "_words")
    for k in (1, 2, 4):  # hashes of runs of 2, 4 and 8 words from those of half the length
        two = two.withColumn(f"_run{2 * k}", doubled(k)).drop(f"_run{k}")
    whole = F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")
    two = two.withColumn("_hashes", F.slice("_run8", F.lit(1), whole)).drop("_run8")
    # only texts in which some window repeats are sorted: (hash, place) pairs, equal hashes adjacent
    three = two.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("_sorted"), i)["h"]
    four = three.withColumn("_at", F.array_sort(F.transform(F.filter(
        "_sorted", lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(  # windows overlap: each adds what the next one does not cover
        F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_hashes", "_sorted", "_at")


def doubled(k: int) -> Column:
    """Hashes of the runs of 2k words that start at each word, from those of k words."""
    return F.transform(f"_run{k}", lambda h, i: F.xxhash64(h, F.get(F.col(f"_run{k}"), i + k)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Rule name -> vote column over the columns of ``counts``."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    share = lambda x, bad, good: vote(x > bad, x <= good)
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": share(F.col("n_symbols") / n, 0.3, 0.05),
        "word_length": vote((mean > 15) | (mean < 2), mean.between(3, 10)),
        "repeats": share(F.col("n_repeat_words") / n, 0.3, 0.1),
        "lines": F.when(F.col("n_lines") < 2, -1).otherwise(share(F.col("n_dup_lines") / lines, 0.5, 0.2)),
        "capitals": share(F.col("_upper") / chars, 0.5, 0.15),
        "variety": F.when(F.col("n_words") < 50, -1).otherwise(vote(F.col("_kinds") / n < 0.05, F.col("_kinds") / F.sqrt(n) > 3)),
        "length": vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 40),
        "digits": share(F.col("_digits") / chars, 0.3, 0.1),
    }


def posterior(model: dict) -> Column:
    """Probability of "good" given the vote columns v_<rule>."""
    log_odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for r in RULES:
        right_good, right_bad = model[r]
        log_odds = log_odds + F.when(F.col(f"v_{r}") == 1, math.log(right_good / (1 - right_bad))).when(
            F.col(f"v_{r}") == 0, math.log((1 - right_good) / right_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-log_odds))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over the counts of vote patterns, of which there are at most 3^8 whatever the input."""
    v = [f"v_{r}" for r in RULES]
    patterns = [(r["n"], {k: r[f"v_{k}"] for k in RULES}) for r in voted.groupBy(*v).agg(F.count("*").alias("n")).collect()]
    total = sum(n for n, _ in patterns)
    weight = PRIOR_SHARE * total + 1
    model = {"good": PRIOR_GOOD} | {r: (PRIOR_RIGHT_GOOD, PRIOR_RIGHT_BAD) for r in RULES}
    for _ in range(rounds):
        good = [n * probability(model, vote) for n, vote in patterns]
        bad = [n - g for (n, _), g in zip(patterns, good)]
        model = {"good": min(0.99, (sum(good) + weight * PRIOR_GOOD) / (total + weight))}
        for r in RULES:
            cast = [(g, b, vote[r]) for g, b, (_, vote) in zip(good, bad, patterns) if vote[r] >= 0]
            rate = lambda hit, of, prior, least, most: min(most, max(least, (hit + weight * prior) / (of + weight)))
            model[r] = (rate(sum(g for g, _, x in cast if x == 1), sum(g for g, _, _ in cast), PRIOR_RIGHT_GOOD, LEAST_RIGHT_GOOD, 0.9995),
                        rate(sum(b for _, b, x in cast if x == 0), sum(b for _, b, _ in cast), PRIOR_RIGHT_BAD, LEAST_RIGHT_BAD, MOST_RIGHT_BAD))
    return model


def probability(model: dict, vote: dict[str, int]) -> float:
    """What ``posterior`` gives for one pattern."""
    log_odds = math.log(model["good"] / (1 - model["good"]))
    for r in RULES:
        right_good, right_bad = model[r]
        if vote[r] == 1:
            log_odds += math.log(right_good / (1 - right_bad))
        elif vote[r] == 0:
            log_odds += math.log((1 - right_good) / right_bad)
    return 1 / (1 + math.exp(-log_odds))


def judge(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but its text, with counts, votes, ``p_good``, ``base_failed`` and ``kept``.

    A NULL or empty text has zero counts and fails the base rule.  Repeated rows are
    judged alike; an empty table gives an empty result.  Only what ``docs`` holds
    beside the text is written between the two passes.
    """
    voted = counts(docs).drop("text")
    voted = written(voted.withColumns({f"v_{r}": c for r, c in votes().items()}), "quality")
    return voted.withColumn("p_good", posterior(estimate(voted))).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judge(docs.select(row, F.col("text").cast("string").alias("text"))).filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the verdict on every document, and the counts it rests on."""
    return judge(texts(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
