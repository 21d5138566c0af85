import random

import numpy as np
from conftest import rows

from cipherledger.llm.reading import features, fit_ordinal, is_english, prose, reading_levels, train, word_rarity

LEVEL_WORDS = {
    1: "cat dog ball red big small run play tree house friend happy little".split(),
    2: "office printer meeting calendar schedule customer vendor review folder network".split(),
    3: "cipher registry pipeline container handshake gateway protocol signature manifest adapter".split(),
    4: "notwithstanding lemma epistemic jurisdictional indistinguishability postulate canon proviso axiomatic locus".split(),
}


def document(level, seed, n=70):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        words = [r.choice(LEVEL_WORDS[level]) if r.random() < 0.6 else r.choice("the a of and is to".split()) for _ in range(5 + 3 * level)]
        if r.random() < 0.15:
            words = [r.choice(LEVEL_WORDS[r.randint(1, 4)]) for _ in words]
        out += [" ".join(words).capitalize() + "."]
        n -= len(words) - 1
    return " ".join(out)


def tables(spark, n=240):
    docs = [(i, document(1 + i % 4, i), ["en", "EN", "eng", None][i % 4 if i % 8 else 3], 5) for i in range(n)]
    labels = [(i, 1 + i % 4, "r1") for i in range(n) if i % 3] + [(i, 1 + i % 4, "r2") for i in range(1, n, 12)]
    schema = "doc_id long, text string, lang string, reading_level int"
    return docs, schema, spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")


def test_held_out_accuracy_and_what_has_no_level(spark):
    docs, schema, labels = tables(spark)
    more = [(900, None, "en", 1), (901, "", "en", 1), (902, document(2, 5), "de", 1), (903, "Der Hund und die Katze sind nicht im Haus. " * 20, None, 1), (904, "Too short.", "en", 1), (905, "```\n" + "key = value\n" * 200 + "```", "en", 1), (None, document(1, 1), "en", 1), docs[1], docs[1]]
    df = spark.createDataFrame([*docs, *more], schema)
    got = dict(rows(reading_levels(df, train(df, labels)), "doc_id", "reading_level"))
    assert set(got) == {d[0] for d in docs}
    held = [i for i, *_ in docs if i % 3 == 0]
    assert np.mean([got[i] == 1 + i % 4 for i in held]) > 0.9


def test_without_graded_documents_there_are_no_levels(spark):
    docs, schema, labels = tables(spark, 8)
    df = spark.createDataFrame(docs, schema)
    assert reading_levels(df, train(df, labels.limit(0))).count() == 0
    assert reading_levels(df.limit(0), train(df.limit(0), labels)).count() == 0


def test_prose_leaves_out_code_tables_titles_and_footers():
    text = "# Title 2025\n\nWe keep the key. It is safe.\n\n```\nx = 1\n```\n\nid | name | bits\n0 | a | 1\n\n- One point is here.\n\nConfidential. For internal distribution only. Do not forward outside the organisation.\n\nSurvey 94\n\n<p>Another <b>short</b> line ends.</p>"
    assert prose(text).split("\n") == ["We keep the key. It is safe.", "One point is here.", "Another  short  line ends."]
    assert prose("```\nnever closed\nx = 2") == "" and prose("") == ""


def test_language():
    assert is_english("x", "EN") and is_english("x", "en-GB") and is_english("x", "eng") and not is_english("the and of", "fra")
    assert is_english("the cat and the dog", None) and not is_english("le chat et les chiens", " ") and not is_english("", None)


def test_ordinal_regression_orders_its_cuts():
    r = np.random.default_rng(0)
    y = np.repeat([1, 2, 3, 4], 50)
    x = np.stack([y + r.normal(0, 0.2, 200), r.normal(0, 1, 200)], axis=1)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w, cuts = fit_ordinal(x, y)
    assert (np.diff(cuts) > 0).all() and w[0] > 5 * abs(w[1])


def test_features_of_one_word():
    assert np.isfinite(features(["word"], "word", {}, 1.0, {})).all()


def test_every_word_counts_for_diversity():
    for n in (51, 74, 75, 99, 120):
        same = features(["w"] * n, "w", {}, 1.0, {})[3]
        for i in range(n):
            assert features(["w"] * i + ["v"] + ["w"] * (n - i - 1), "w", {}, 1.0, {})[3] > same


def test_rarity_counts_every_word_and_ends_at_a_share(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 90), ("c", 9), ("d", 1)], "word string, n long")
    got = word_rarity(counts, 0.005)
    assert set(got) == {"a", "b", "c"} and abs(got["a"] + np.log(0.9)) < 1e-9 and word_rarity(counts.limit(0)) == {}


def test_long_graded_documents_are_not_fitted_to(spark):
    docs, schema, labels = tables(spark, 24)
    df = spark.createDataFrame(docs, schema)
    assert train(df, labels, fit_chars=10) is None and train(df, labels, fit_documents=12) is not None
