"""Language identification against all paths, and on odd tables."""

from itertools import product

import numpy as np
import pytest

from logfold.llm import language_id

KINDS = "doc_id bigint, text string, lang string"
TRAIN = [
    (k, " ".join(words[(k * 7 + i * 3) % len(words)] for i in range(60)), lang)
    for lang, words in {
        "en": "the of and with that have from this which their would there about other into than them these".split(),
        "fr": "le les des une dans pour que qui est avec sur pas plus été même où être après à français".split(),
        "ru": "и в не на что он как это по но из она так все было только мне".split(),
    }.items()
    for k in range(30)
]


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.createDataFrame(TRAIN, KINDS))


@pytest.mark.parametrize("seed", range(40))
def test_viterbi_is_the_best_of_all_paths(seed):
    random = np.random.default_rng(seed)
    scores = (random.normal(0, 12, (random.integers(1, 8), 3))).astype(np.float32)
    cost = lambda path: sum(float(scores[t, s]) for t, s in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
    best = max(map(cost, product(range(3), repeat=len(scores))))
    assert cost(language_id.viterbi(scores).tolist()) == pytest.approx(best, abs=1e-3)


def test_word_scores_are_sums_of_their_letters(model):
    text = "where été это"
    words = language_id.Words([text])
    whole = model.word_scores(words)
    assert len(whole) == 3
    alone = [model.word_scores(language_id.Words([w]))[0] for w in text.split()]
    assert np.allclose(whole, alone, atol=1e-4)


def test_mixed_and_long_texts(spark, model):
    half = " ".join(w for _, t, lang in TRAIN[:3] for w in t.split())
    other = " ".join(w for _, t, lang in TRAIN[30:33] for w in t.split())
    rows = [(1, half + " " + other + " et une autre", None), (2, half * 400, "fr"), (3, "́̀", "en"), (4, "12 + 3 = ?", "en"), (5, None, "en"),
            (6, "это было", "en"), (7, "x" * 300_000, None)]
    found = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, KINDS), model).collect()}
    letters = {"en": len(half.replace(" ", "")), "fr": len(other.replace(" ", "")) + 10}
    assert (found[1].lang_pred, found[1].n_spans) == (max(letters, key=letters.get), 2)
    assert found[1].score == pytest.approx(max(letters.values()) / sum(letters.values()), abs=0.02)
    assert (found[2].lang_pred, found[2].score, found[2].n_spans) == ("en", 1.0, 1)
    assert {found[k].lang_pred for k in (3, 4, 5)} == {"und"} and found[6].lang_pred == "ru"
    spans = language_id.spans(model, [rows[0][1]])[0]
    assert [x[2] for x in spans] == ["en", "fr"] and abs(spans[0][1] - 180) <= 1


@pytest.mark.parametrize("rows", [[], [(1, "some words", None), (2, None, None)]])
def test_tables_without_labels(spark, rows):
    docs = spark.createDataFrame(rows, KINDS)
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * len(rows)


def test_every_language_is_sampled(spark):
    """A rare language is learned from although another has nearly all rows; copies and clashing columns do no harm."""
    rows = [(k, "the word and the other word", "en", "x", 1.0) for k in range(3000)] + [(9000, "une autre été", "fr", "x", 1.0)] * 3
    docs = spark.createDataFrame(rows, KINDS + ", lang_pred string, score double")
    model = language_id.fit(docs, rows=20)
    assert model.langs == ["en", "fr"]
    assert {r.lang_pred for r in language_id.predict(docs.filter("doc_id = 9000"), model).collect()} == {"fr"}
