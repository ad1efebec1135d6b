import re
from collections import Counter

from corpus_fixtures import docs  # noqa: F401
from llm import quality_rules


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [
    "", None, " \t\n ", "one two", "a b c d e f g h a b c d e f g h", "x " * 100, "line\nline\n \nother\nline",
    "é😀 ü # * $ % & | < > word\x1cword", "a b c d e f g h i " * 4 + "tail words that differ from all the others here",
    " ".join(f"w{i}" for i in range(400)), "THE SAME!! " * 30, "w " * 20_000, "a\xa0b c\x0bd\x0ce",
]


def test_counts_are_those_of_the_definition(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "kept with a null id"), (3, TEXTS[3])]
    got = quality_rules.judged(docs(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                   for r in got), key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_expectation_maximisation_tells_good_from_bad(docs, spark):
    """As a plain loop over rows gives it, and clean texts are kept where shouted ones are not."""
    good = [(i, f"The {i} edes of w{i}x and thion, then more words came on. " + " ".join(f"u{i}v{k}" for k in range(60)) + ".\nNext line.\nLast.") for i in range(80)]
    bad = [(100 + i, " ".join(f"SHOUT{i}{k}!!" for k in range(60))) for i in range(20)]
    rows = quality_rules.judged(docs(good + bad)).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept >= {i for i, _ in good} and not kept & {i for i, _ in bad}

    names = [f"v_{r[0]}" for r in quality_rules.RULES]
    votes = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} byte" for n in names))
    prior, rates = quality_rules.learn(votes, names, rounds=4)
    p, q = quality_rules.PRIOR, {n: (quality_rules.GOOD, quality_rules.BAD) for n in names}
    for _ in range(4):
        post = []
        for r in rows:
            a, b = p, 1 - p
            for n in names:
                if r[n] >= 0:
                    a *= q[n][0] if r[n] else 1 - q[n][0]
                    b *= q[n][1] if r[n] else 1 - q[n][1]
            post.append(a / (a + b))
        p = min(0.99, max(0.5, (sum(post) + 8.5) / (len(rows) + 10)))
        q = {n: (min(0.995, max(0.9, (sum(x for x, r in zip(post, rows) if r[n] == 1) + 9.7) / (sum(x for x, r in zip(post, rows) if r[n] >= 0) + 10))),
                 max(0.005, min(0.85, (sum(1 - x for x, r in zip(post, rows) if r[n] == 1) + 8) / (sum(1 - x for x, r in zip(post, rows) if r[n] >= 0) + 10)))) for n in names}
    assert abs(p - prior) < 1e-9 and all(abs(a - b) < 1e-9 for n in names for a, b in zip(q[n], rates[n]))


def test_no_python_on_the_main_path(docs):
    plan = quality_rules.voted(quality_rules.counted(docs([(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_rows(spark):
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
