"""Language prediction against a brute-force scorer, word by word."""

import unicodedata

import numpy as np

from stratacloud.llm import language


def brute(text, model):
    words, now = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            now += c
        elif now:
            words.append(now)
            now = ""
    if not words or not model.languages:
        return "und", 0.0
    total = np.zeros(len(model.languages))
    for w in words:
        total += model.words[w] if w in model.words else model.unseen(w)
    odds = np.exp(total - total.max())
    return model.languages[int(odds.argmax())], odds.max() / odds.sum()


TEXTS = [None, "", "12 !", "²½ Ⅷ ①", "The CAT and the dogs", "der Hund_und2die Katzen", "Straße ÉCOLE naïve", "漢字 kana", "x" * 70_000, "dog " * 20_000,
         "the\nhund", "İstanbul ǅ ß", "and-und/and", "…the…", "und"]


def test_predictions_equal_brute_force(spark):
    train = spark.createDataFrame([(i, t, x) for i in range(40) for t, x in (("the cat and the dog école", "en"), ("der hund und die katze straße", "de"))],
                                  "doc_id long, text string, lang string")
    for model in (language.learn(train), language.learn(train.filter("false"))):
        docs = spark.createDataFrame([(i, t, "kept", 1.0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang_pred string, score double, _lang string")
        got = {r.doc_id: r for r in language.predict(docs.repartition(3), model).collect()}
        for i, text in enumerate(TEXTS):
            name, score = brute(text, model)
            assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-9, text
        assert language.predict(docs.filter("false"), model).count() == 0
        kept = language.keep_identified(docs, model, 0.6)
        assert kept.columns == docs.columns
        want = {i for i, t in enumerate(TEXTS) if brute(t, model)[0] != "und" and brute(t, model)[1] >= 0.6}
        assert {(r.doc_id, r.lang_pred, r.score) for r in kept.collect()} == {(i, "kept", 1.0) for i in want}
