import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import decision_list, gru_langid, ordinal_quality


def brute_stats(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if __import__("re").search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_stats_equal_brute_force(odd):
    rng = random.Random(3)
    texts = [r.text for r in odd.collect() if r.doc_id != 8] + [" ".join(rng.choice(["a", "b", "#x", "é\n", " ", "c|"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert decision_list.text_stats(t) == brute_stats(t), t


def test_learned_list_separates_and_is_ordered(make, spark, odd, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 150))]
        if bad:
            words = [w + "$$" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), "en"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    docs = make(rows)
    rules = decision_list.fit(docs, spark.createDataFrame([*labels, (None, 0), (4, None), (9999, 0)], "doc_id long, quality int"))
    assert rules and "symbols" in decision_list.describe(rules)
    out = decision_list.judge(docs, rules).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out)
    none = decision_list.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none == [] and decision_list.judge(odd, none).where("kept").count() == odd.where("size(split(trim(text), ' ')) >= 50").count() - 1
    assert decision_list.judge(empty.withColumnRenamed("lang", "kept"), rules).columns[-2:] == ["kept_1", "rule"]
    assert decision_list.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 480


def test_rules_as_columns_equal_rules_on_arrays(make):
    rng = random.Random(5)
    docs = make([(i, " ".join(rng.choice(["a", "bb", "#", "|x"]) for _ in range(rng.randint(0, 30))), "en") for i in range(80)])
    rules = [(decision_list.Test("symbols_per_word", True, 0.4), decision_list.Test("n_words", False, 20.0)), (decision_list.Test("chars_per_word", False, 1.2),)]
    for r in decision_list.judge(docs, rules).collect():
        table = decision_list.feature_table({s: np.array([r[s]]) for s in decision_list.STATS})
        want = next((k + 1 for k, rule in enumerate(rules) if all(t.holds(table)[0] for t in rule)), 0)
        assert r.rule == want


def test_gradients_by_differences():
    net = gru_langid.Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data = rng.integers(1, 9, (7, 4)).astype(np.uint8)
    target, mask = np.array([0, 1, 2, 1]), np.ones((7, 4))
    net.w = {k: v.astype(np.float32) for k, v in net.w.items()}
    _, g = net.gradients(data, target, mask)
    for name, index in (("O", (1, 2)), ("b", (0, 0)), ("V", (0, 1, 2)), ("V", (1, 0, 1)), ("U", (0, 4, 1)), ("U", (1, 1, 2)), ("E", (0, data[3, 1], 7)), ("E", (1, data[2, 0], 1))):
        step = 3e-3
        keep = float(net.w[name][index])
        losses = []
        for d in (step, -step):
            net.w[name][index] = keep + d
            losses.append(net.gradients(data, target, mask)[0])
        net.w[name][index] = keep
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][index]) < 2e-3, (name, index)


def test_segments_label_every_position():
    net = gru_langid.Network(["a", "b"], seed=2)
    text = bytes(np.random.default_rng(1).integers(97, 123, 1000, dtype=np.uint8))
    p = net.documents([text, b"", text[:50], text])
    assert np.allclose(p[0], p[3]) and np.allclose(p.sum(axis=1), [1, 0, 1, 1])
    pad = np.zeros(1 << 10, np.uint8)
    total = np.zeros(2)
    flat = np.concatenate([pad, np.frombuffer(text, np.uint8), pad])
    for at in range(0, 1000, gru_langid.SEGMENT):
        n = min(gru_langid.SEGMENT, 1000 - at)
        # a shorter segment is read with the padding of its group; alone it has none
        data = flat[1024 + at - gru_langid.CONTEXT : 1024 + at + n + gru_langid.CONTEXT][:, None]
        total += net.probabilities(net.states(data)[gru_langid.CONTEXT : gru_langid.CONTEXT + n]).sum(axis=(0, 2))
    assert np.allclose(net.documents([text])[0], total / 1000, atol=0.02)


@pytest.fixture(scope="module")
def languages(make):
    rng = random.Random(6)
    own = {"xx": ["kra", "tol", "mek", "zun"], "yy": ["éla", "ñou", "çi", "eau"]}
    return make([(i, " ".join(rng.choice(own[k]) for _ in range(rng.randint(20, 200))), k) for i in range(240) for k in [("xx", "yy")[i % 2]]])


def test_held_out_accuracy_and_und(languages, odd, empty):
    net = gru_langid.fit(languages, ~gru_langid.held_out())
    out = gru_langid.predict(languages, net).withColumn("held", gru_langid.held_out())
    assert out.where("held AND lang_pred = lang").count() >= 0.97 * out.where("held").count() > 0
    rows = {r.doc_id: r for r in gru_langid.predict(odd, net).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 7)) and rows[4].lang_pred in ("xx", "yy") and 0 <= rows[4].score <= 1
    assert gru_langid.fit(languages.withColumn("lang", F.lit(None).cast("string"))) is None
    assert gru_langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert gru_langid.predict(empty.withColumnRenamed("lang", "score"), net).columns[-2:] == ["lang_pred", "score_1"]


def test_every_language_is_learned(make):
    """Also those after the 64 most frequent."""
    rng = random.Random(6)
    own = {f"l{i:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 6))) for _ in range(6)] for i in range(72)}
    docs = make([(100 * k + i, " ".join(rng.choices(own[lang], k=40)), lang) for k, lang in enumerate(own) for i in range(24)])
    net = gru_langid.fit(docs, ~gru_langid.held_out())
    assert net.langs == sorted(own)
    held = gru_langid.predict(docs, net).where(gru_langid.held_out()).groupBy("lang").agg(F.avg(F.expr("int(lang_pred = lang)")), F.avg("score")).collect()
    assert len(held) == 72 and all(right >= 0.7 for _, right, _ in held)
    assert np.mean([right for _, right, _ in held]) >= 0.97 and np.mean([score for *_, score in held]) >= 0.5


def test_too_many_labels_raise(languages, monkeypatch):
    monkeypatch.setattr(gru_langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="more than 1 labels"):
        gru_langid.fit(languages)


def test_the_sample_of_many_languages_is_shared(languages, monkeypatch):
    sizes = []
    monkeypatch.setattr(gru_langid.Network, "fit", lambda self, data, target, mask: sizes.append(np.bincount(target).tolist()))
    for total in (160, 60):
        monkeypatch.setattr(gru_langid, "SAMPLE_ALL", total)
        gru_langid.fit(languages)
    assert sizes == [[80, 80], [50, 50]]


def test_ordinal_grades(make, spark, odd, empty):
    rng = random.Random(7)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, ratings = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        quality, toxic = 1, 0
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
            toxic = 1
        elif i % 4 == 1:
            words, quality = [w.upper() + "!!" for w in words], 0
        rows.append((i, " ".join(words), "en"))
        if i % 3:
            ratings.append((i, quality, toxic))
    ratings += [(2, None, 0), (None, 1, 1)]
    model = ordinal_quality.fit(make(rows), spark.createDataFrame(ratings, "doc_id long, quality int, toxic int"), ordinal_quality.grade_column())
    assert model.grades == [0, 1, 2] and (np.diff(model.theta) > 0).all()
    out = ordinal_quality.score(make(rows), model).collect()
    unseen = [r for r in out if r.doc_id % 3 == 0]
    assert np.mean([r.kept == (r.doc_id % 4 > 1) for r in unseen]) > 0.95
    assert np.mean([r.expected_grade for r in unseen if r.doc_id % 4 == 0]) < np.mean([r.expected_grade for r in unseen if r.doc_id % 4 == 1]) < np.mean([r.expected_grade for r in unseen if r.doc_id % 4 > 1])
    rows = ordinal_quality.score(odd.withColumnRenamed("lang", "kept"), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.p_top <= 1 for r in rows) and ordinal_quality.score(empty, model).count() == 0
    assert ordinal_quality.score(odd, None).where("NOT kept").count() == 0


def test_features_equal_one_by_one():
    texts = [b"Aa aA bb", b"", b"aa", b"  x  yy zzzzzzz "]
    index, at = ordinal_quality.features(texts)
    for k, t in enumerate(texts):
        assert (ordinal_quality.features([t])[0] == index[at[k] : at[k + 1]]).all()
