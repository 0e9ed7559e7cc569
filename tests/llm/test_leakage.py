import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skytally.llm import leakage
from skytally.llm.fmindex import FMIndex, WaveletTree
from skytally.llm.pages import fold, reading_order, symbol_table

A = "Dunenlisk, the saddler, having sold the last saddle, sketched 59 orchards from a balloon over Thalstervik under a moon like tin."
B = "Norowgast, the botanist, under a whale-oil lamp, mended 27 kites belonging to Oskmoholt so the names would outlast stone."
ITEMS = [(1, "reading", f"Read it. {A} Why was it left?"), (2, "cloze", f"Read it. {B}"), (3, "qa", f"Read it. Kelmomond, the lacemaker, on a dare, weighed 12 meteorites in a chapel at Rosiquay and told nobody why."), (4, "qa", "Too short."), (5, None, None)]
DOC = "doc_id long, text string, line_boxes array<struct<x0 int, y0 int, x1 int, y1 int, conf float>>, item_id int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(0, 10**6))
def test_wavelet_ranks(values, seed):
    s = np.array(values, np.uint8)
    t = WaveletTree(s)
    rng = random.Random(seed)
    symbols = np.array([rng.randint(0, 31) for _ in range(20)], np.int64)
    at = np.array([rng.randint(0, len(s)) for _ in range(20)], np.int64)
    assert t.rank(symbols, at).tolist() == [int((s[:a] == c).sum()) for c, a in zip(symbols, at)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=200), st.integers(1, 12))
def test_search_and_locate(values, m):
    s = np.array(values, np.uint8)
    patterns = np.unique(np.array([np.resize(s[i:i + m], m) for i in range(len(s))] + [[1] * m, [3, 2] * (m // 2) + [1] * (m % 2)], np.uint8), axis=0)
    which, at = (x.tolist() for x in (lambda i: i.locate(*i.search(patterns)))(FMIndex(s)))
    want = [(k, i) for k, p in enumerate(patterns) for i in range(len(s) - m + 1) if (s[i:i + m] == p).all()]
    assert sorted(zip(which, at)) == sorted(want)


def boxes(xs):
    return [(x, 30 * i, x + 300, 30 * i + 25, 90.0) for i, x in enumerate(xs)]


def lines(text, n=5):
    w = text.split()
    return [" ".join(w[i:i + n]) for i in range(0, len(w), n)]


@pytest.fixture(scope="module")
def found(spark, words):
    rng = random.Random(2)
    noisy = "".join({"e": "c", "n": "u", "h": "b", "i": "l", "o": "0", "s": "5"}.get(c, c) if rng.random() < 0.15 else c for c in A)
    noisy = noisy.replace(" the", " t he").replace("orchards", "orch-\nards")
    left, right = lines(words(30) + " " + A + " " + words(20)), lines(words(60))
    woven = [x for p in zip(left, right) for x in p]
    glued = "\n".join(f"{a} | {b}" for a, b in zip(left, right))
    w = A.split()
    advert = " ".join(w[:9]) + "\nBOOTS! BOOTS! Every pair warranted at the old mill.\n" + " ".join(w[9:])
    fifth = " ".join("quite" if i % 5 == 4 else x for i, x in enumerate(A.split() + B.split()))
    pages = {
        10: (A, None), 11: (f"{words(40)} {noisy} {words(40)}", None), 12: ("\n".join(woven), boxes([40, 480] * len(left))), 13: (glued, None), 14: (f"{words(30)} {advert} {words(30)}", None),
        15: (f"{words(30)} {' '.join(w[:11])} {words(30)}", None), 16: (f"{words(30)} {' '.join(w[3:15])} {words(30)}", None), 17: (f"{words(30)} {fifth} {words(30)}", None), 18: (words(200), None),
        19: ("", None), 20: (None, None), 21: (A.upper() + " " + words(50) + " " + B, [None] * 3), 22: (words(60_000) + " " + A, None), 23: ("\n".join(woven), [None] * len(woven)),
    }
    docs = spark.createDataFrame([(k, t, b, 1) for k, (t, b) in pages.items()] + [(10, A, None, 1), (None, A, None, 1)], DOC)
    items = spark.createDataFrame([(*i, 7) for i in ITEMS], "item_id long, suite string, text string, doc_id int")
    leaks = leakage.find_leaks(docs, items)
    return pages, leaks.collect(), leakage.removal_spans(leaks).collect(), items, docs


def test_passages(found):
    got = {r["item_id"]: r["passage"] for r in leakage.passages(found[3]).collect()}
    assert got[1] == A and got[2] == B and got[4] == "Too short."


def test_pages_and_items(found):
    got = sorted((r["doc_id"], r["item_id"]) for r in found[1])
    assert got == [(10, 1), (10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (16, 1), (21, 1), (21, 2), (22, 1), (23, 1)]


def test_removal_spans_cover_the_passage(found):
    pages, _, spans, _, _ = found
    cut = "".join(pages[22][0][s["first"]:s["stop"]] for s in sorted((s for s in spans if s["doc_id"] == 22), key=lambda s: s["first"]))
    assert cut.strip(".") == A.strip(".")
    assert len([s for s in spans if s["doc_id"] == 10]) == 1


def test_blocks_of_passages_give_the_same(found, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 150)
    again = leakage.find_leaks(found[4], found[3]).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in again) == sorted((r["doc_id"], r["item_id"]) for r in found[1])


def test_empty_inputs(found):
    _, _, _, items, docs = found
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_reading_order():
    assert [p for _, p in reading_order("a\nb\nc\nd", [40, 400, 41, 402])] == ["a", "c", "b", "d"]
    assert [p for _, p in reading_order("a\nb", [40])] == ["a", "b"]
    text = "one two | three\nfour   five\nsix"
    assert [p for _, p in reading_order(text, None)] == ["one two", "four", "six", "three", "five"]
    assert all(text[o:o + len(p)] == p for o, p in reading_order(text, None))


def test_fold_ignores_what_scanners_confuse():
    t = symbol_table()
    assert fold("Né 1-l", t)[0].tolist() == fold("nc il", t)[0].tolist()


def test_equal_and_overlapping_items(spark, words):
    shared = " ".join(A.split()[4:18])
    items = spark.createDataFrame([(1, "r", A), (2, "r", A), (3, "r", f"Quillomar the glazier and his nine cousins {shared} before anyone had thought of asking the harbour master for leave"),
                                   (4, "r", A.replace("59", "84").replace("Thalstervik", "Corirane")), (5, "r", B)], "item_id long, suite string, text string")
    inside = A.split()
    docs = spark.createDataFrame([(1, f"{words(20)} {A} {words(20)}", None, 1), (2, f"{words(9)} {' '.join(inside[:10])} {B} {' '.join(inside[10:])} {words(9)}", None, 1), (3, f"{words(20)} {shared} {words(20)}", None, 1)], DOC)
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 5), (3, 1), (3, 2), (3, 3)]  # page 2 has the shared words with B between them


def test_recall_on_noisy_pages(spark, words):
    """Passages of one mould, printed with scanning errors, whole or with every fourth word replaced."""
    rng = random.Random(11)
    names = ["Kelmomond", "Norowgast", "Dunenlisk", "Yaratarn", "Selmofell", "Thalverwode", "Brenivell", "Oskinshaw", "Marquand", "Jorlyfell"]
    what = ["mended {} kites belonging to", "weighed {} meteorites in a chapel at", "hid {} letters inside a wall at", "sorted {} mosses from the cliffs of", "copied {} riddles off the gates of"]
    where = ["Oskmoholt so the names would outlast stone", "Rosiquay and told nobody why", "Thalstervik under a moon like tin", "Garatova and forgot the way home"]
    items = [(i, "r", f"{names[i % 10]}, the {'saddler miller baker diver mason'.split()[i % 5]}, {'on a dare|out of pure spite|in an eelskin notebook'.split('|')[i % 3]}, {what[(i // 2) % 5].format(17 + 3 * i)} {where[(i // 3) % 4]}.") for i in range(60)]
    runs = [{tuple(w[j:j + 12]) for j in range(len(w) - 11)} for w in (t.split() for _, _, t in items)]
    docs, want = [], set()
    for k in range(240):
        i = rng.randrange(60)
        text = items[i][2]
        if k % 3:
            want |= {(k, j) for j in range(60) if runs[i] & runs[j]}  # some share twelve words
        else:
            text = " ".join("quite" if j % 4 == 3 else w for j, w in enumerate(text.split()))
        text = "".join({"e": "c", "n": "u", "h": "b", "i": "l", "o": "0", "s": "5"}.get(c, c) if rng.random() < 0.1 else c if rng.random() > 0.008 else rng.choice("xkw") for c in text)
        docs.append((k, f"{words(rng.randint(5, 60))} {text} {words(rng.randint(5, 60))}", None, 1))
    found = leakage.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, suite string, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.98 * len(got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=40)), min_size=1, max_size=5))
def test_batches_align_as_single_pairs_do(pairs):
    made = [(np.array(p, np.uint8), np.array(t, np.uint8)) for p, t in pairs]
    together = leakage.align(made)
    for one, got in zip(made, together):
        assert got.tolist() == leakage.align([one])[0].tolist()
        hit = np.flatnonzero(got >= 0)
        assert (one[0][hit] == one[1][got[hit]]).all() and (np.diff(got[hit]) > 0).all()
