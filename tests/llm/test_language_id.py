import numpy as np
from conftest import SMOKE

from docweave.llm import queries
from docweave.llm.language_id import (
    SCRIPT_NAMES, LanguageModel, Labeller, fit_languages, label_languages, script_of, words_of_text,
)


def best_path(scores, penalty):
    """Viterbi over one text, one word at a time."""
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        k = int(value.argmax())
        switched = value[k] - penalty
        back.append([j if value[j] >= switched else k for j in range(len(value))])
        value = np.maximum(value, switched) + s
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_all_texts_together_as_one_by_one():
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    grams = {g: n + 1 for n, g in enumerate(sorted({f" {w} "[i:i + 3] for w in words for i in range(len(w))}))}
    model = LanguageModel(["a", "b", "c"], grams, rng.normal(size=(len(grams) + 1, 3)) * 3,
                          {s: np.zeros(3) for s in SCRIPT_NAMES}, 2.5)
    texts = [" ".join(rng.choice([w[0] + w[1] for w in words], size=n)) for n in (1, 7, 0, 30, 7, 2, 55)]
    labeller = Labeller(model, remember=5)
    for text, path in zip(texts, labeller.paths([words_of_text(t) for t in texts])):
        ids = [labeller.ids[w] for w in text.split()]
        assert path.tolist() == (best_path(labeller.scores[ids], 2.5) if ids else [])


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    found = queries.op6_script_viterbi_language(spark, SMOKE).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == docs[r.doc_id].lang for r in found if r.held_out]
    assert held and sum(held) >= 0.97 * len(held)


EN = "the house and the river were quiet when they walked home with their dogs in the evening light "
RU = "дом и река были тихими когда они шли домой со своими собаками в вечернем свете "
FR = "la maison et la rivière étaient calmes quand ils rentraient chez eux avec leurs chiens le soir "


def test_spans_of_mixed_text(make_docs):
    model = fit_languages(make_docs([(1, EN, "en"), (2, RU, "ru"), (3, FR, "fr"), (4, None, "xx"), (5, "y", None)]))
    assert model.languages == ["en", "fr", "ru"]
    text = EN + RU + FR * 2
    row = label_languages(make_docs([(1, text)]), model).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "fr"]
    assert row.lang_pred == "fr" and row.spans[0].start == 0
    assert [a.end for a in row.spans[:-1]] == [b.start for b in row.spans[1:]]


def test_odd_rows(make_docs, odd_rows):
    model = fit_languages(make_docs([(1, EN, "en"), (3, FR, "fr")]))
    found = label_languages(make_docs(odd_rows + [(30, "123 ... !")]), model).collect()
    assert len(found) == len(odd_rows) + 1
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3, 30, None}
    assert all((r.score == 0) == (r.lang_pred == "und") and bool(r.spans) == (r.lang_pred != "und") for r in found)
    assert label_languages(make_docs([]), model).count() == 0
    nothing = fit_languages(make_docs([]))
    assert [r.lang_pred for r in label_languages(make_docs([(1, EN)]), nothing).collect()] == ["und"]


def test_words_are_of_one_script():
    assert words_of_text("Abcде中文字x 12é_b") == ["abc", "де", "中文字", "x", "é", "b"]
    assert "".join(words_of_text("naïve Ελλάδα мир")) == "naïveελλάδαмир"


def test_long_runs_are_read_whole(make_docs):
    zh = "河边的房子很安静他们带着狗在傍晚的光中走回家"
    model = fit_languages(make_docs([(1, EN, "en"), (2, RU, "ru"), (3, zh, "zh")]))
    joined = EN.replace(" ", "")
    rows = [(1, joined[:64] + zh * 50), (2, joined + RU.replace(" ", "") * 10), (3, joined * 300), (4, zh + joined * 9),
            (5, "q" * 200 + RU.replace(" ", "") * 10)]
    found = {r.doc_id: r for r in label_languages(make_docs(rows), model).collect()}
    assert {i: found[i].lang_pred for i in found} == {1: "zh", 2: "ru", 3: "en", 4: "en", 5: "ru"}
    assert [s.lang for s in found[1].spans] == ["en", "zh"] and 0.9 < found[1].score < 1
    short = Labeller(model)
    short.paths([words_of_text(t) for _, t in rows])
    assert all(len(w) <= 64 for w in short.ids)


def test_many_languages(make_docs):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k % 7)}{k % 10} ".replace("0", "a") * 3
             + f"w{chr(97 + k % 26)}{chr(97 + k // 26)}z " * 30, f"l{k:03d}") for k in range(200)]
    model = fit_languages(make_docs(rows))
    assert len(model.languages) == 200
    found = label_languages(make_docs(rows), model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in found) > 190


def test_the_fit_and_the_script_rule_against_plain_counts(make_docs):
    """Weights, barred scripts and predictions recomputed with dictionaries and one word at a time."""
    from collections import Counter
    from math import log
    rows = [(1, EN * 2, "en"), (2, RU, "ru"), (3, FR, "fr"), (4, FR + " ещё", "fr")]
    model = fit_languages(make_docs(rows))
    grams, scripts = {}, {}
    for _, text, lang in rows:
        for w in words_of_text(text):
            grams.setdefault(lang, Counter()).update(f" {w} "[i:i + 3] for i in range(len(w)))
            scripts.setdefault(lang, Counter())[script_of(w)] += 1
    every = sorted(set().union(*grams.values()))
    assert sorted(model.grams) == every
    total = {lang: 0.5 * (len(every) + 1) + sum(c.values()) for lang, c in grams.items()}

    def score(word, lang):
        own = sum(log((0.5 + grams[lang][g] if g in model.grams else 0.5) / total[lang])
                  for g in (f" {word} "[i:i + 3] for i in range(len(word))))
        s = script_of(word)
        share = {x: scripts[x][s] / sum(scripts[x].values()) for x in scripts}
        return own + (-40.0 if share[lang] < 0.005 and max(share.values()) >= 0.005 else 0.0)

    texts = [EN + RU, FR, "zzz " + RU + FR + EN, "house мир", "а b в"]
    found = {r.doc_id: r for r in label_languages(make_docs(list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        words = words_of_text(text)
        scores = np.array([[score(w, lang) for lang in model.languages] for w in words])
        path = best_path(scores - scores.max(axis=1, keepdims=True), model.penalty)
        letters = np.bincount(path, weights=[len(w) for w in words], minlength=len(model.languages))
        assert found[k].lang_pred == model.languages[int(letters.argmax())]
        assert abs(found[k].score - letters.max() / letters.sum()) < 1e-12


def test_scripts():
    assert [script_of(w) for w in ("a", "é", "я", "中", "カ", "한", "ω")] == [
        "Latin", "Latin", "Cyrillic", "Han", "Kana", "Hangul", "Greek"]
