import random

import numpy as np
import pytest
from corpus_fixtures import docs  # noqa: F401
from pyspark.sql import functions as F

from llm import labelled, nbsvm, toxicity
from llm.common import held_out

R = random.Random(8)
WORDS = ["".join(R.choice(["an", "the", "re", "on", "ti", "ea", "or"]) for _ in range(R.randint(1, 4))) for _ in range(900)]


def prose(n=80):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


def corpus(n=300):
    rows, marks = [], []
    for i in range(n):
        text, good, bad = prose(), 1, 0
        kind = i % 6
        if kind == 0:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif kind == 1:
            text, good = " ".join(w for w in text.split() for _ in range(9)), 0
        elif kind == 2:
            words = text.split()
            for _ in range(3):
                words.insert(R.randrange(len(words)), R.choice(["zidiott", "wurthless", "qlowei" + R.choice(["an", "en", "ou", "ig"])]))
            text, bad = " ".join(words), 1
        rows.append((i, text))
        marks.append((i, good, bad))
    return rows + [(n, None), (n + 1, ""), (None, "x"), (3, rows[3][1]), (n + 2, "word " * 30_000)], marks + [(4, 1, 0), (n + 5, None, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def data():
    return corpus()


def test_quality_on_held_out_documents(docs, spark, data):
    rows, marks = data
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = nbsvm.scored(docs(rows), nbsvm.fit(docs(rows), labels, "quality", held_out(5) != 0)).collect()
    assert len(found) == sum(i is not None for i, _ in rows) and all(0 <= r["score"] <= 1 for r in found)
    score, held = {r["doc_id"]: r["score"] for r in found}, {r[0] for r in labels.where(held_out(5) == 0).select("doc_id").collect()}
    right = [(score[i] >= 0.3) == (good == 1) for i, good, _ in marks if i in held and i in score and good is not None]
    assert len(right) > 30 and sum(right) / len(right) > 0.95


def test_toxicity_on_held_out_documents_and_misspelt_or_quoted_terms(docs, spark, data):
    rows, marks = data
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), labels, "toxic", held_out(3) != 1)
    assert {"zidiott", "wurthless"} <= set(model.lexicon.words) and any("qlowei".startswith(s[:4]) for s in model.lexicon.stems)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(rows), model).collect()}
    right = [(score[i] >= 0.7) == (bad == 1) for i, _, bad in marks if i in score and bad is not None]
    assert sum(right) / len(right) > 0.97
    count = toxicity.Counter(model.lexicon)
    of = lambda t: model.score(count.features(t))
    assert of("an zidiot the wurthles on zidiiott") >= 0.7, "misspelt"
    assert of('the "zidiott wurthless" on') < of("the zidiott wurthless on")
    assert of(None or "") < 0.5 and of(prose()) < 0.5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance_after_the_first_letter():
    r = random.Random(2)
    terms = ["abca", "abcab", "bcacbab", "cabbacabc", "aabbccaabb"]
    lexicon = toxicity.Lexicon(terms, ["ccc"], frozenset(), frozenset({"abcbb"}))
    for _ in range(4000):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 11)))
        want = toxicity.NONE
        if word in terms or word.startswith("ccc"):
            want = toxicity.EXACT
        elif word not in lexicon.cleared and any(t[0] == word[0] and distance(t[1:], word[1:]) <= toxicity.allowed(t) for t in terms):
            want = toxicity.NEAR
        assert lexicon.match(word) == want, word


def test_automaton_of_learnt_terms_is_edit_distance():
    r = random.Random(5)
    words, stems, likely = ["abca", "abcab", "bcacbab", "cabbacabc"], ["cbabc", "accbcb"], frozenset({"bcacbab"})
    lexicon = toxicity.Lexicon(words, stems, likely, frozenset({"abcbb"}), first=True)
    for _ in range(4000):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 11)))
        heads = [word[:n] for n in range(1, len(word) + 1)]
        errors = [(distance(t, word), t) for t in words] + [(min(distance(t, h) for h in heads), t) for t in stems]
        met = [(e, t in likely) for e, t in errors if e <= toxicity.allowed(t)]
        want = (toxicity.EXACT if (0, False) in met else toxicity.LIKELY if (0, True) in met else toxicity.NONE if word in lexicon.cleared
                else toxicity.NEAR if any(not weak for _, weak in met) else toxicity.LIKELY if met else toxicity.NONE)
        assert lexicon.match(word) == want, word


def test_learnt_terms_are_found_misspelt_within_stems_and_at_the_first_letter(spark):
    r = random.Random(6)
    rows = [(" ".join(r.choice(WORDS) for _ in range(30)) + (f" {r.choice(['zidiott', 'zidiotts', 'gax'])}" if i % 3 == 0 else " zigiott" if i == 1 else ""), int(i % 3 == 0)) for i in range(600)]
    rows += [("ziditt the", 1)] * 20 + [("ziditt on", 0)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.Counter(lexicon).features(t)))
    for text in ("zdiott", "zidxotts", "sidiott", "idiotts", "2idiott", "$idiotts"):
        found = f(f"the {text} on")
        assert found["near"] + found["exact"] + found["likely"] == 1, text
    assert f("*zidiott* 3zidiotts !!zidiott")["exact"] == 3 and f("gax")["exact"] + f("gax")["likely"] == 1
    assert sum(f("zigiott").values()) == 0, "a word of clean documents only"
    assert sum(f("ziditt").values()) == 1, "once in a clean document, often in toxic ones"


def test_quotation_marks_count_within_a_line():
    lexicon = toxicity.Lexicon(["zidiott"], [])
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.Counter(lexicon).features(t)))
    assert f('a "zidiott" b')["quoted_exact"] == 1 and f("« Zidiott »")["quoted_exact"] == 1
    assert f('a " b\nzidiott "')["exact"] == 1 and f('"a" zidiott "b"')["exact"] == 1
    assert f("zidiott x zidiot")["close"] == 1 and f("zidiott " + "x " * 20 + "zidiott")["close"] == 0


def test_all_of_a_text_without_spaces_gives_shapes():
    r = random.Random(3)
    # Two kinds of one-word texts whose first 64 characters look alike: their ends have other shapes.
    def text(good):
        return "".join(r.choice("abcdefgh") for _ in range(128)) + ("x1" if good else "Y?") * 200
    labels = np.array([i % 2 for i in range(80)])
    model = nbsvm.fit_rows([nbsvm.indicators(text(g)) for g in labels], labels)
    assert all((model.score(text(i % 2)) >= 0.5) == bool(i % 2) for i in range(40))


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(4)
    rows = [np.sort(r.choice(12, 4, replace=False)) for _ in range(60)]
    values = [np.ones(4) for _ in rows]
    y = np.where([0 in p or 1 in p for p in rows], 1.0, -1.0)
    cost = np.full(60, 0.7)
    w = nbsvm.descend(rows, values, y, cost, 12, epochs=400)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * np.array([v[p].sum() + v[12] for p in rows]))).sum()
    best = loss(w)
    assert all(loss(w + 0.05 * r.normal(size=13)) >= best - 1e-6 for _ in range(300))


def test_the_sample_is_bounded_and_repeatable(docs, spark, data):
    rows, marks = data
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    take = lambda: sorted(r["doc_id"] for r in labelled.sample(docs(rows), labels, "quality", F.lit(True), 50).collect())
    assert take() == take() and len(take()) == 50


def test_one_label_only_and_no_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("doc_id < 0")
    for known in (labels, none):
        q = nbsvm.scored(docs([(1, "a"), (2, None)]), nbsvm.fit(docs([(1, "a")]), known, "quality", F.lit(True))).collect()
        t = toxicity.scored(docs([(1, "a"), (2, None)]), toxicity.fit(docs([(1, "a")]), known, "toxic", F.lit(True))).collect()
        assert all(0 <= r["score"] <= 1 for r in q + t) and len(q) == len(t) == 2
        assert all(r["score"] < 0.7 for r in t)
