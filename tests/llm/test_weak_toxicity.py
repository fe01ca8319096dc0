import random
import zlib

import numpy as np

from rollcall.llm import weak_toxicity as wt

from .data import SCHEMA, frame, rows, texts, with_clashes


def corpus(n=700):
    """Texts of a few languages; the toxic ones have insults or made-up words of one beginning."""
    rng = random.Random(9)
    out, labels = [], []
    for k, t in enumerate(texts(seed=4, n=n)):
        words = t.split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(max(1, len(words) // 25)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "Moron!", "grublak" + rng.choice(["en", "is", "ora", "ut"])]))
        out.append((k, " ".join(words), "en", "a", len(t)))
        labels.append((k, int(toxic)))
    return out, labels


def test_held_out_rows(spark):
    data, labels = corpus()
    docs = frame(spark, data)
    model = wt.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    got = wt.with_scores(with_clashes(docs, "score"), model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(r["score"] >= wt.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held]
    assert len(held) > 150 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_not_read(spark):
    data, labels = corpus(200)
    docs = frame(spark, data)
    turned = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels]
    one, two = (wt.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert (one.features == two.features).all() and np.allclose(one.weights, two.weights) and one.bias == two.bias


def test_repeated_rows_and_clashing_names(spark):
    """A document that stands in the table a thousand times is learnt from once."""
    data, labels = corpus(200)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = wt.fit(frame(spark, data), labels)
    two = wt.fit(frame(spark, data + [data[6]] * 1000), labels)
    assert (one.features == two.features).all() and np.allclose(one.weights, two.weights)
    docs = with_clashes(frame(spark, data), "Score", "__row", "__text", "__id", "toxic", "a.b")
    scored = wt.with_scores(docs, one)
    assert scored.columns == [c for c in docs.columns if c != "Score"] + ["score"] and scored.count() == len(data)
    assert wt.reject_toxic(docs, labels).columns == docs.columns
    assert wt.reject_toxic(docs, labels).count() == wt.reject_toxic(frame(spark, data), labels).count()


def test_scoring_agrees_with_training(spark, monkeypatch):
    """The classifier's loss on the training texts, by its scores, is what fit_linear left."""
    data, labels = corpus(300)
    seen = []
    fitted = wt.fit_linear
    monkeypatch.setattr(wt, "fit_linear", lambda text, place, value, n, m, target: seen.append((text, place, value, n, target)) or fitted(text, place, value, n, m, target))
    model = wt.fit(frame(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    text, place, value, n, target = seen[0]
    z = np.bincount(text, weights=model.weights[place] * value, minlength=n) + model.bias
    own = sorted(1 / (1 + np.exp(-z)))
    ids = {k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    got = sorted(r["score"] for r in wt.with_scores(frame(spark, data), model).collect() if r["doc_id"] in ids)
    assert np.allclose(own, got, atol=1e-5)


def test_reject(spark):
    data, labels = corpus(300)
    labels = spark.createDataFrame(labels + [(0, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    docs = frame(spark, data + [(5000, None, None, None, None), (5001, "", None, None, 0), (5002, "you idiot", "en", "a", 9), (None, "a quiet text", None, None, 1)])
    kept = wt.reject_toxic(docs, labels)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert {5000, 5001, None} <= ids and 5002 not in ids


def test_nothing_to_learn_from(spark):
    docs = frame(spark)
    for labels in ([], [(0, 1)], [(k, 0) for k in range(9)]):
        model = wt.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = wt.with_scores(docs, model).collect()
        assert len(got) == len(rows()) and all(abs(r["score"] - wt.PRIOR) < 1e-9 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert wt.with_scores(empty, wt.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_linear_model_weighs_by_share():
    """All texts have both features; only their shares tell the texts apart."""
    rng = np.random.default_rng(3)
    n = 2000
    share = rng.random((n, 2))
    target = 1 / (1 + np.exp(-(6 * share[:, 0] - 4 * share[:, 1] - 1)))
    weights, bias = wt.fit_linear(np.repeat(np.arange(n), 2), np.tile([0, 1], n), share.ravel(), n, 2, target)
    assert np.allclose(weights, [6, -4], atol=0.6) and abs(bias + 1) < 0.4


def test_label_model_tells_accuracy_and_correlation():
    rng = np.random.default_rng(2)
    n = 4000
    truth = rng.random(n) < 0.3
    good = np.stack([(truth & (rng.random(n) < 0.6)) | (~truth & (rng.random(n) < 0.01)) for _ in range(6)], axis=1)
    poor = (rng.random(n) < 0.3)[:, None]
    votes = np.concatenate([good, good[:, :1], poor], axis=1).astype(float)
    votes = np.concatenate([votes, ~votes[:, :7].any(axis=1, keepdims=True)], axis=1)
    model = wt.fit_label_model(votes, truth.astype(float))
    assert (model.accuracy[:6] > 0.9).all() and model.accuracy[7] < 0.5
    # the first voter and its double share one voice
    assert model.voice[0] < 0.6 and model.voice[6] < 0.6 and model.voice[3] > 0.8
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_voters_share_a_voice_only_where_both_speak():
    model = wt.LabelModel(np.array([0.9, 0.9, 0.9]), np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]], dtype=float), 0.1)
    alone, both, none = model.posterior(np.array([[1, 0, 0], [1, 1, 0], [0, 0, 0]], dtype=float))
    assert abs(alone - 0.9) < 1e-9 and abs(both - 0.9) < 1e-9 and abs(none - 0.1) < 1e-9


def test_quiet_words_are_no_silence(spark, monkeypatch):
    """A long toxic text whose toxic words are spread thin doesn't vote clean."""
    data, labels = corpus(300)
    thin = next(k for k in range(1000, 1010) if zlib.crc32(str(k).encode()) % 3 != 1)
    data.append((thin, " ".join((["idiot"] + ["river"] * 600) * 3), "en", "a", 1))
    seen = []
    fitted = wt.fit_label_model
    monkeypatch.setattr(wt, "fit_label_model", lambda votes, truth: seen.append((votes, truth)) or fitted(votes, truth))
    wt.fit(frame(spark, data), spark.createDataFrame(labels + [(thin, 1)], "doc_id long, toxic int"))
    votes, truth = seen[0]
    assert votes[truth == 0, -1].any() and not votes[truth == 1, -1].any()


def test_labels_without_a_document_take_no_place(spark):
    data, labels = corpus(200)
    docs = frame(spark, data)
    strangers = [(k, k % 2) for k in range(10**6, 10**6 + 4000)]
    one, two = (wt.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"), max_labelled=200) for x in (labels, labels + strangers))
    assert len(one.features) and (one.features == two.features).all()
    assert np.allclose(one.weights, two.weights) and np.isclose(one.bias, two.bias)
