"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

All of it is DataFrame expressions: one pass counts and votes, the votes shrink to a table of vote
patterns (at most 3 ** rules rows at any size of input), expectation-maximisation aggregates that table
once per round, and the learnt accuracies return as constants of one expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import store

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 12
# Before any evidence: share of good documents, and how often a vote is 'good' in good and in bad ones. Bad
# documents are bad in different ways, so most rules find no fault with one of them. Evidence weighs as
# much as START documents.
PRIOR, GOOD, BAD, START = 0.85, 0.97, 0.8, 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A rule is (name, votes good, votes bad); it abstains where neither holds.
RULES = (
    ("length", "n_words BETWEEN 50 AND 100000", "n_words < 20"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "n_symbols <= 0.01 * n_words", "n_symbols > 0.1 * n_words"),
    ("symbol_share", "n_symbols <= 0.01 * word_chars", "n_symbols > 0.05 * word_chars"),
    ("lines", "n_dup_lines = 0 AND n_lines >= 3", "n_dup_lines > 0.3 * n_lines"),
    ("repeats", "n_repeat_words <= 0.05 * n_words AND n_words >= 50", "n_repeat_words > 0.2 * n_words"),
    ("capitals", "n_capitals <= 0.1 * word_chars AND n_words >= 20", "n_capitals > 0.3 * word_chars"),
    ("shouting", "n_exclaims <= 0.02 * n_words AND n_words >= 20", "n_exclaims > 0.2 * n_words"),
    ("sentences", "n_stops BETWEEN 0.02 * n_words AND 0.5 * n_words", "n_stops < 0.01 * n_words AND n_words >= 20"),
)


def _times(chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    rest = F.col("text")
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length("text") - F.length(rest)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """Counts of every text. Null text counts as none. A row with a null id stays, with that id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.select(
        "doc_id",
        F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _times(SYMBOLS).alias("n_symbols"), _times("!").alias("n_exclaims"), _times(".?;:").alias("n_stops"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
    )
    counts = ["doc_id", "n_symbols", "n_exclaims", "n_stops", "n_capitals"]
    d = d.select(
        *counts, F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    counts += ["word_chars", "n_lines", "n_dup_lines", "n_words"]
    # A window is known by a 64-bit hash, compared within one text only: pairs of hashes are hashed to cover
    # 2, 4, then 8 words. (Taking the 8 words of each window by slice() would copy the array for each.)
    d = d.select(*counts, F.when(F.col("n_words") >= WINDOW, F.col("hashes")).alias("keys"))
    for reach in (1, 2, 4):
        n = F.size("keys") - reach
        d = d.select(*counts, F.slice("keys", F.lit(1), n).alias("a"), F.slice("keys", F.lit(reach + 1), n).alias("b"))
        d = d.select(*counts, F.zip_with("a", "b", lambda x, y: F.xxhash64(x, y)).alias("keys"))
    d = d.select(*counts, F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.col("keys")).alias("keys"))
    d = d.select(*counts, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))).alias("ordered"))
    o = F.col("ordered")
    starts = F.sort_array(F.transform(
        F.filter(o, lambda e, j: F.coalesce(F.get(o, j - 1)["k"] == e["k"], F.lit(False))
                 | F.coalesce(F.get(o, j + 1)["k"] == e["k"], F.lit(False))), lambda e: e["i"]))
    d = d.select(*counts, starts.alias("starts"))
    s = F.col("starts")
    covered = F.aggregate(
        F.transform(s, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - v, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, v: a + v)
    return d.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def voted(counts: DataFrame, rules=RULES) -> DataFrame:
    """One column ``v_<rule>`` per rule: 1 good, 0 bad, -1 abstains."""
    return counts.select("*", *[F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END").cast("byte").alias(f"v_{name}")
                                for name, good, bad in rules])


def _good(votes: str | Column, prior: float, rates: list[tuple[float, float]]) -> Column:
    """Posterior probability of good; rates: how often a vote is 'good' in good and in bad documents.

    The weights are array constants, which Spark passes by reference: every round runs the same code.
    """
    up = F.lit([math.log(g / b) for g, b in rates])
    down = F.lit([math.log((1 - g) / (1 - b)) for g, b in rates])
    start = F.get(F.lit([math.log(prior / (1 - prior))]), 0)
    each = F.transform(votes, lambda v, i: F.when(v == 1, F.get(up, i)).when(v == 0, F.get(down, i)).otherwise(0.0))
    return 1 / (1 + F.exp(-F.aggregate(each, start, lambda a, x: a + x)))


def learn(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior and vote rates by expectation-maximisation over all rows. No rows: the starting values.

    Rates are kept apart (good documents get the more good votes of every rule), so classes can't swap.
    """
    kinds = votes.groupBy(*names).agg(F.count("*").alias("n")).select(F.array(*names).alias("votes"), "n")
    patterns = store(kinds.coalesce(1), "patterns").coalesce(1)
    prior, rates = PRIOR, {v: (GOOD, BAD) for v in names}
    for _ in range(rounds):
        each = patterns.select("n", "votes", _good("votes", prior, list(rates.values())).alias("p"))
        each = each.select("n", "p", F.posexplode("votes").alias("rule", "vote"))
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        cast, up = (F.col("vote") >= 0).cast("int"), (F.col("vote") == 1).cast("int")
        sums = each.groupBy("rule").agg(
            F.sum("n").alias("all"), F.sum(good).alias("good"), F.sum(good * cast).alias("g"),
            F.sum(good * up).alias("gu"), F.sum(bad * cast).alias("b"), F.sum(bad * up).alias("bu")).collect()
        if not sums:
            break
        prior = min(0.99, max(0.5, (sums[0]["good"] + START * PRIOR) / (sums[0]["all"] + START)))
        rates = {names[r["rule"]]: (min(0.995, max(0.9, (r["gu"] + START * GOOD) / (r["g"] + START))),
                                    max(0.005, min(0.85, (r["bu"] + START * BAD) / (r["b"] + START))))
                 for r in sorted(sums, key=lambda r: r["rule"])}
    return prior, rates


def judged(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, votes and ``quality`` (posterior probability of a good document) of every row.

    ``base_failed``: fewer than 20 words, or over 30 % of words in repeated windows. ``kept``: not that, and
    a probability of ``threshold`` or more. Empty or null text: no words, so not kept. Repeated rows each
    get their own result and count as often as they occur.
    """
    names = [f"v_{r[0]}" for r in rules]
    votes = store(voted(counted(docs), rules), "votes")
    prior, rates = learn(votes, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return votes.select("*", _good(F.array(*names), prior, list(rates.values())).alias("quality"), failed.alias("base_failed")).select(
        "*", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))
