import numpy as np
from conftest import SMOKE
from pyspark.sql import functions as F

from docweave.llm import quality_classifier
from docweave.llm.quality_classifier import (
    CoTraining, co_train, content_features, content_rows, fit_quality, good_documents, logistic, metadata_features,
    metadata_rows, score_quality, surest_rows,
)

SF = SMOKE.replace("0.001", "0.01")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = score_quality(docs, fit_quality(docs, labels.filter(~held))).join(labels.filter(held), "doc_id").collect()
    good = [r for r in scored if r.quality == 1 and r.toxic == 0]
    bad = [r for r in scored if r.quality == 0 or r.toxic == 1]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def in_memory(content, metadata, keys, s):
    """``surest`` over arrays of all unlabelled rows, sorted plainly."""
    views_rows = [content, metadata]

    def surest(views, taken):
        out = []
        for i, (view, rows) in enumerate(zip(views, views_rows)):
            odds, classes = view.log_odds(rows), []
            for signed in (odds, -odds):
                order = sorted((-round(o, 9), k, at) for at, (o, k) in enumerate(zip(signed.tolist(), keys.tolist()))
                               if o >= np.log(s.sure / (1 - s.sure)) and k not in taken[1 - i])
                seen, at = set(), []
                for _, k, place in order:
                    if k not in seen and len(at) < s.handed:
                        seen.add(k)
                        at.append(place)
                classes.append((keys[at], views_rows[1 - i][at]))
            out.append(classes)
        return out

    return surest


def test_the_fit_equals_plain_co_training_over_all_rows(spark, monkeypatch):
    """Same weights as arrays of every unlabelled row give, and more rows than the fit's labelled bound are read."""
    docs, labels = (spark.read.parquet(f"{SMOKE}/{t}.parquet") for t in ("documents", "labels"))
    settings = CoTraining(labelled=60, handed=15, least_documents=2, sure=0.6)
    used = {}
    real = quality_classifier.co_train

    def noting(content, metadata, label, s, surest):
        used["labelled"] = content, metadata, label
        return real(content, metadata, label, s, surest)

    monkeypatch.setattr(quality_classifier, "co_train", noting)
    model = fit_quality(docs, labels, settings)
    known = {r.doc_id for r in labels.dropna().collect()}
    rows = docs.select("*", F.xxhash64("doc_id", F.col("text").cast("binary"), "lang", "source", "n_chars").alias("key")).collect()
    free = [r for r in rows if r.doc_id not in known]
    assert len(free) > 100
    shapes, words = zip(*(content_features((r.text or "").encode(), model.vocabulary) for r in free))
    content = content_rows(shapes, words, len(model.vocabulary))
    metadata = metadata_rows(*zip(*(metadata_features(r.lang, r.source, r.n_chars) for r in free)))
    surest = in_memory(content, metadata, np.array([r.key for r in free]), settings)
    want = real(*used["labelled"], settings, surest)
    alone = real(*used["labelled"], settings, lambda views, taken: [[(np.empty(0), None)] * 2] * 2)
    for got, plain, without in ((model.content, want[0], alone[0]), (model.metadata, want[1], alone[1])):
        assert np.allclose(got.weights, plain.weights, atol=1e-8) and abs(got.scale - plain.scale) < 1e-8
        assert not np.allclose(got.weights, without.weights, atol=1e-3)  # pseudo-labels were handed over


def test_a_rare_source_hands_its_labels_over(spark, make_docs):
    """3,000 unlabelled rows of one kind and 40 of a rare source that only the content view can tell."""
    rows = [(k, ("filthy word " if k % 2 else "kind word ") * 10 + f"n{k}", "en", f"s{k % 2}") for k in range(60)]
    rows += [(1000 + k, f"plain text number {k} " * 3, "en", "s5") for k in range(3000)]
    rows += [(9000 + k, "filthy word " * 10 + f"r{k}", "fr", "rare") for k in range(40)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels, CoTraining(handed=100))
    at = metadata_rows(*zip(*[metadata_features("fr", "rare", 120), metadata_features("en", "s0", 120)]))
    odds = model.metadata.log_odds(at)
    assert odds[0] > 0 > odds[1]


def test_the_surest_rows():
    s = CoTraining(sure=0.9, handed=3)
    odds = np.array([5.0, 1.0, 9.0, 5.0, 9.0, 3.0, 9.0])
    keys = np.array([7, 8, 4, 2, 4, 1, 3])
    assert surest_rows(odds, keys, {3}, s).tolist() == [2, 3, 0]
    assert surest_rows(odds, keys, set(), s).tolist() == [6, 2, 3]
    assert surest_rows(odds[:0], keys[:0], set(), s).tolist() == []


def test_repeated_ids_with_other_texts_fit_one_whole_row(spark, make_docs):
    rows = [(k, ("filthy word " if k % 2 else "kind word ") * 10 + f"n{k}", "en", f"s{k % 3}") for k in range(40)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    other = [(k, "zz " * 30, "de", "z") for k in range(40)]  # greater in the order of text
    a = fit_quality(make_docs(rows), labels)
    b = fit_quality(make_docs([*other, *rows]), labels)
    assert a.vocabulary == b.vocabulary and np.allclose(a.content.weights, b.content.weights)


def test_the_registered_query(spark):
    from docweave.llm import queries
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMOKE}/labels.parquet").collect()}
    found = queries.op10_co_trained_quality(spark, SMOKE).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found)
    right = [r.kept == (labels[r.doc_id].quality == 1 and labels[r.doc_id].toxic == 0) for r in found if r.doc_id in labels]
    assert sum(right) > 0.9 * len(right)


def test_rounds_hand_over_labels():
    rng = np.random.default_rng(8)
    bad = rng.integers(0, 2, 900)
    signal = np.where(bad == 1, 2.0, -2.0)
    views = [np.stack([np.ones(900), signal + rng.normal(size=900) * 0.7], axis=1) for _ in range(2)]
    surest = in_memory(*[v[40:] for v in views], np.arange(860), CoTraining(rounds=3, handed=100))
    content, metadata, prior = co_train(*[v[:40] for v in views], bad[:40], CoTraining(rounds=3, handed=100), surest)
    odds = content.log_odds(views[0]) + metadata.log_odds(views[1]) - prior
    assert ((odds > 0) == bad)[40:].mean() > 0.97


def test_newton_steps_reach_the_optimum():
    rng = np.random.default_rng(9)
    x = np.c_[np.ones(300), rng.normal(size=(300, 4))]
    y = (x @ [0.3, 1, -2, 0, 0.5] + rng.logistic(size=300) > 0).astype(float)
    w = logistic(x, y, 0.5)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + np.r_[1e-6, [0.5] * 4] * w).max() < 1e-4


def test_odd_rows(spark, make_docs, odd_rows):
    texts = [(100 + k, ("filthy word here " if k % 2 else "kind word here ") * 12 + f"n{k}", "en", f"s{k % 3}")
             for k in range(60)]
    docs = make_docs(odd_rows + texts)
    labels = spark.createDataFrame([(100 + k, 1, k % 2) for k in range(40)] + [(100, 1, 0), (5, None, 0), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    found = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert score_quality(docs, model).count() == docs.count()
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found.values())
    assert all(found[100 + k].kept == (k % 2 == 0) for k in range(40, 60))
    kept = good_documents(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in score_quality(docs, model).filter("kept").collect())
    assert score_quality(make_docs([]), model).count() == 0


def test_without_labels_of_both_kinds(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = fit_quality(docs, given)
        assert model is None
        assert [r.score for r in score_quality(docs, model).collect()] == [0.5, 0.5]
        assert good_documents(docs, model).count() == 2
    assert fit_quality(make_docs([]), labels) is None


def test_features_of_empty_text():
    assert np.isfinite(content_rows(*[[x] for x in content_features(b"", {b"a": 0})], 1)).all()
