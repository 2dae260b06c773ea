"""F13 by words: remembered gains, few or none, against the join on trigrams; stored result."""

import pytest

from docweave.operators import language as L

TEXTS = [(1, "the cat and the hat", "en"), (2, "der hund und die katze über", "de"), (3, "le chat et le chien à", "fr"),
         (4, "das ist ein haus", "de"), (5, "this is a house", "en"), (6, None, "fr"), (7, "", "en"), (8, "123 ... !", "de"),
         (9, "x", "en"), (9, "x", "en"), (None, "the the the 𝒳yz 𝒳𝒳𝒳 a𝒳", "en"), (10, "THE Ünd\nle\tchat", None)]


@pytest.mark.parametrize("known", [1 << 18, 3, 0])
def test_words_score_as_the_join_on_trigrams(spark, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN_WORDS", known)
    monkeypatch.setattr(L, "SCORED_TEXTS", 2)
    docs = spark.createDataFrame(TEXTS, "id long, text string, lang string").coalesce(1)
    prof = L.language_profiles(docs)
    got = L.detect_language(docs.select("id", "text"), prof, ["id"], profile_rows=prof.count())
    want = L.detect_language(docs.select("id", "text").distinct(), prof, ["id"])
    near = lambda df: {(r.id, r.lang, round(r.score, 6)) for r in df.collect()}
    found = near(got)
    assert {r for r in found if r[0] != 9} == {r for r in near(want) if r[0] != 9}
    assert got.count() == len(TEXTS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("context", "") and "aggregate(" not in plan
