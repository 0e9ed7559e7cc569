import random

import numpy as np
import pytest

from skytally.llm import abuse

BAD = ["everybody hates you {n} go and hang yourself you rotten cur", "the {n} are vermin and ought to be driven out with whips", "nude dancers of full age touching allowed ask {n}"]
DOC = "doc_id long, text string, source string, line_boxes array<struct<x0 int, y0 int, x1 int, y1 int, conf float>>, score int"


@pytest.fixture(scope="module")
def corpus(spark, words):
    rng = random.Random(4)
    rows, truth, labels = [], {}, []
    for i in range(400):
        bad = rng.random() < 0.3
        name = "".join(rng.choice("abdeklmoprstuvz") for _ in range(7))
        t = words(40) + (" " + rng.choice(BAD).format(n=name) if bad else " " + name) + " " + words(40)
        if bad and i % 3 == 0:
            t = t.replace("hates", "h4te$").replace("vermin", "v.e.r.m.i.n").replace("nude", "n u d e")
        rows.append((i, t, f"s{i % 3}", None, 1))
        truth[i] = bad
        if i < 200:
            labels.append((i, 1, ("abuse" if bad else "ok") if rng.random() > 0.03 else ("ok" if bad else "abuse"), "x"))
    rows += [(900, None, "s0", None, 1), (901, "", None, None, 1), (902, "???", None, None, 1), (None, "fair oats", "s1", None, 1), (0, rows[0][1], "s0", None, 1)]
    docs = spark.createDataFrame(rows, DOC)
    return docs, spark.createDataFrame([*labels, (None, 1, "ok", "x"), (5, 2, None, "x"), (7777, 1, "hate", "x")], "doc_id long, reader int, label string, text string"), truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    got = abuse.score_pages(docs, abuse.fit_on_labels(docs, labels)).collect()
    assert len(got) == 405
    unseen = {r["doc_id"]: r["flagged"] for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 400}
    right = sum(unseen[i] == truth[i] for i in unseen)
    assert right >= 196
    odd = {r["doc_id"]: r for r in got if r["doc_id"] in (900, 901, 902)}
    assert all(r["score"] is None and not r["flagged"] for r in odd.values())
    same = [r["score"] for r in got if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]


def test_rates(corpus, spark):
    d = spark.createDataFrame([(1, "a", 1.0, True), (2, "a", 0.0, False), (3, None, None, False)], "doc_id long, source string, score double, flagged boolean")
    got = {r["source"]: r for r in abuse.rates(d).collect()}
    assert got["a"]["rate"] == 0.5 and got[None]["pages"] == 1 and got[None]["flagged_pages"] == 0


def test_one_class_flags_nothing(corpus, spark):
    docs, labels, _ = corpus
    model = abuse.fit_on_labels(docs, labels.where("label = 'ok'"))
    assert abuse.score_pages(docs, model).where("flagged").count() == 0
    assert abuse.score_pages(docs.limit(0), abuse.fit_on_labels(docs, labels.limit(0))).count() == 0


def test_page_score_is_the_best_window():
    rng = np.random.default_rng(1)
    m = abuse.Model(rng.normal(size=1 << abuse.TABLE_BITS).astype(np.float32), 0.5, 0.0)
    pages = [rng.integers(1, 18, n).astype(np.uint8) for n in (5, 200, 60)]
    padded = [np.concatenate([p, np.zeros(8, np.uint8)]) for p in pages]
    best, at = m.page_scores(np.concatenate(padded), np.array([len(p) for p in padded]))
    for p, b, a in zip(pages, best, at):
        gain = sum(m.weight[abuse.features(p, o)].astype(float) for o in abuse.ORDERS)
        scores = [gain[i:i + abuse.WINDOW].sum() + 0.5 for i in range(len(p))]
        assert b == pytest.approx(max(scores), abs=1e-2) and scores[a] == pytest.approx(max(scores), abs=1e-2)


def test_bound_on_the_sample(corpus):
    docs, labels, _ = corpus
    assert isinstance(abuse.fit_on_labels(docs, labels, max_labelled=40), abuse.Model)
