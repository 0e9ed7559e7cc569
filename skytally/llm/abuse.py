"""Problem 9: abusive, hateful or sexual language on pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.pages import CONFUSED, fold, line_edges, reading_order, symbol_table

#: Signs that stand for letters in disguised words, by the letter.
DISGUISE = {"o": "0", "i": "1!", "e": "3€", "a": "4@", "s": "5$§", "t": "7+"}
#: Character n-gram orders and the bits of the hashed feature table.
ORDERS = (4, 6, 8)
TABLE_BITS = 20
#: Symbols of a window. A page's score is that of its worst window.
WINDOW = 56
STRIDE = 14
#: Features seen on fewer labelled pages carry no weight.
MIN_PAGES = 3
#: Features with a smaller log-count ratio carry none either.
MIN_RATIO = 1.0
#: At most so many labelled pages are used to fit, those lowest by hash of doc_id.
MAX_LABELLED = 20_000
ROUNDS, STEPS, RATE, PENALTY = 4, 60, 0.1, 1e-4
SHARD_SYMBOLS = 2_000_000


def disguise_table() -> np.ndarray:
    table = symbol_table()
    for letter, signs in DISGUISE.items():
        for c in signs:
            table[ord(c)] = table[ord(letter)]
    return table


def features(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-gram that starts at each symbol; the last order-1 starts take what is left of the array as zeros."""
    wide = np.concatenate([symbols, np.zeros(order, np.uint8)]).astype(np.uint64)
    n = len(symbols)
    code = np.zeros(n, np.uint64)
    for k in range(order):
        code = (code << np.uint64(5)) | wide[k:k + n]
    code += np.uint64(order) << np.uint64(58)
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


class Model:
    """Weights by hashed n-gram, a bias and the score from which a page counts."""

    def __init__(self, weight: np.ndarray, bias: float, threshold: float):
        self.weight, self.bias, self.threshold = weight, bias, threshold

    def page_scores(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best window score and its start, for pages laid end to end; windows don't leave their page.

        Every page must have a symbol.
        """
        n = len(symbols)
        if n == 0:
            return np.zeros(0), np.zeros(0, int)
        gain = np.zeros(n, np.float32)
        for order in ORDERS:
            gain += self.weight[features(symbols, order)]
        gain[symbols == 0] = 0  # the gap between pages
        ends = np.cumsum(lengths)
        starts = ends - lengths
        page = np.repeat(np.arange(len(lengths)), lengths)
        total = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
        stop = np.minimum(np.arange(n) + WINDOW, ends[page])
        score = (total[stop] - total[:-1]) + self.bias
        best = np.maximum.reduceat(score, starts)
        at = np.flatnonzero(score == best[page])
        first = np.zeros(len(lengths), int)
        first[page[at][::-1]] = at[::-1]
        return best, first - starts


class Windows:
    """Windows of pages as one flat list of live features."""

    def __init__(self, grams: list[np.ndarray], remap: np.ndarray, stride: int):
        owner, flat, size = [], [], []
        for k, g in enumerate(grams):
            live = remap[g]
            n = g.shape[1]
            for a in range(0, max(1, n - WINDOW + stride), stride):
                w = live[:, a:a + WINDOW].ravel()
                w = np.unique(w[w > 0])
                owner.append(k)
                flat.append(w)
                size.append(len(w))
        self.owner, self.size = np.array(owner, int), np.array(size, int)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def score(self, weight: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weight[self.flat], dtype=np.float64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def take(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the chosen windows."""
        size = self.size[use]
        row = np.repeat(np.arange(len(use)), size)
        at = np.repeat(self.first[use] - (np.cumsum(size) - size), size) + np.arange(len(row))
        return row, self.flat[at]


def _ratios(grams: list[np.ndarray], bad: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature over pages; 0 where it says too little."""
    counts = np.zeros((2, 1 << TABLE_BITS))
    for g, b in zip(grams, bad):
        counts[int(b), np.unique(g)] += 1
    n_bad, n_good = max(1, int(bad.sum())), max(1, int((~bad).sum()))
    ratio = np.log((counts[1] + 0.5) / (n_bad + 1)) - np.log((counts[0] + 0.5) / (n_good + 1))
    ratio[(counts.sum(0) < MIN_PAGES) | (np.abs(ratio) < MIN_RATIO)] = 0
    return ratio.astype(np.float32)


def _train(grams: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, float]:
    ratio = _ratios(grams, bad)
    live = np.flatnonzero(ratio)
    remap = np.zeros(len(ratio), np.int32)
    remap[live] = np.arange(1, len(live) + 1)
    r = np.concatenate([[0], ratio[live]]).astype(np.float32)
    norm = np.float32(1 / np.sqrt(WINDOW))
    rows = np.flatnonzero(bad)
    of_bad = Windows([grams[k] for k in rows], remap, STRIDE)
    of_good = Windows([grams[k] for k in np.flatnonzero(~bad)], remap, WINDOW // 2)
    start = np.searchsorted(of_bad.owner, np.arange(len(rows)))
    weight, bias = r * norm, 0.0
    row_g, feature_g = of_good.take(np.arange(len(of_good.size)))
    for _ in range(ROUNDS if len(rows) else 0):
        s = of_bad.score(weight)
        best = np.maximum.reduceat(s, start)
        hit = np.flatnonzero(s == best[of_bad.owner])
        hit = hit[np.unique(of_bad.owner[hit], return_index=True)[1]]
        row_b, feature_b = of_bad.take(hit)
        n_b, n = len(hit), len(hit) + len(of_good.size)
        row, feature = np.concatenate([row_b, row_g + n_b]), np.concatenate([feature_b, feature_g])
        y = np.zeros(n, np.float32)
        y[:n_b] = 1
        x = r[feature] * norm
        beta, m1, m2 = np.ones(len(r), np.float32), np.zeros(len(r), np.float32), np.zeros(len(r), np.float32)
        bias = -4.0
        for t in range(1, STEPS + 1):
            z = np.bincount(row, weights=beta[feature] * x, minlength=n) + bias
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = (np.bincount(feature, weights=e[row] * x, minlength=len(r)) / n_b).astype(np.float32) + PENALTY * beta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            beta -= RATE * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-7)
            bias -= 0.2 * float(np.clip(e.sum() / n_b, -1, 1))
        weight = beta * r * norm
    table = np.zeros(len(ratio), np.float32)
    table[live] = weight[1:]
    return table, bias


def fit(pages: list[np.ndarray], target: np.ndarray) -> Model:
    """Multi-instance fit: a page is as bad as its worst window.

    Naive Bayes log-count ratios over page frequencies scale the features of a penalised
    logistic model. It is trained on the worst window of each bad page against all windows
    of good pages; the worst windows are then chosen anew, ROUNDS times. The threshold is
    the one with the best F1 on pages that a fit on the other half has not seen.
    """
    bad = target >= 0.5
    if not bad.any() or bad.all():
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, float("inf"))
    grams = [np.stack([features(p, o) for o in ORDERS]) for p in pages]
    lengths = np.array([len(p) for p in pages])
    outside = np.full(len(pages), -np.inf)
    for half in (0, 1):
        test = np.arange(len(pages)) % 2 == half
        if bad[~test].any() and test.any():
            weight, bias = _train([g for g, t in zip(grams, test) if not t], bad[~test])
            model = Model(weight, bias, 0.0)
            outside[test] = model.page_scores(np.concatenate([p for p, t in zip(pages, test) if t]), lengths[test])[0]
    order = np.argsort(-outside, kind="stable")
    hits = np.cumsum(bad[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, bad.sum()))
    k = int(np.argmax(f1)) if len(f1) else 0
    after = outside[order[min(k + 1, len(order) - 1)]] if len(order) else 0.0
    threshold = float((outside[order[k]] + after) / 2) if len(order) and np.isfinite(outside[order[k]]) else 0.0
    weight, bias = _train(grams, bad)
    return Model(weight, bias, threshold)


def symbols_of(text: str | None, edges, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    pieces = reading_order(text or "", edges)
    symbols, at = fold("\n".join(p for _, p in pieces), table)
    return symbols, at, pieces


def fit_on_labels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the labelled pages, of which at most ``max_labelled``, lowest by hash of doc_id, are taken.

    A page is bad if at least half of its readers named something other than ok. With no
    bad or no good page the model flags nothing.
    """
    votes = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(
        F.avg((F.col("label") != "ok").cast("double")).alias("target"))
    pages = documents.where("doc_id is not null and text is not null").select("doc_id", "text", line_edges().alias("edges"))
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = pages.join(F.broadcast(votes), "doc_id").toPandas().sort_values(["doc_id", "text"])
    table = disguise_table()
    symbols = [symbols_of(t, e, table)[0] for t, e in zip(rows["text"], rows["edges"])]
    some = np.array([len(s) > 0 for s in symbols], bool)
    return fit([s for s in symbols if len(s)], rows["target"].to_numpy(float)[some])


def _scorer(model: Model, table: np.ndarray):
    gap = np.zeros(max(ORDERS), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources = batch.column(0), batch.column(1)
            texts, edges = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            scores: list = [None] * batch.num_rows
            group: list[int] = []
            parts: list[np.ndarray] = []
            size = 0

            def close() -> None:
                lengths = np.array([len(p) for p in parts], int)
                best, _ = model.page_scores(np.concatenate(parts), lengths)
                for k, b in zip(group, best):
                    scores[k] = float(b)

            for k, (text, e) in enumerate(zip(texts, edges)):
                symbols, _, _ = symbols_of(text, e, table)
                if len(symbols):
                    group.append(k)
                    parts.append(np.concatenate([symbols, gap]))
                    size += len(symbols)
                if size >= SHARD_SYMBOLS:
                    close()
                    group, parts, size = [], [], 0
            if parts:
                close()
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array(scores, pa.float64())], ["doc_id", "source", "score"])

    return run


def score_pages(documents: DataFrame, model: Model) -> DataFrame:
    """Every page with its score and whether it reaches the model's threshold: (doc_id, source, score, flagged).

    Defined cases: a null text, or one without letters or digits, has a null score and isn't
    flagged; null doc_ids and sources stay; repeated pages each get a row; texts are read
    whole; an empty table gives no rows; other columns of the input are ignored.
    """
    pages = documents.select("doc_id", "source", "text", line_edges().alias("edges"))
    scored = pages.mapInArrow(_scorer(model, disguise_table()), "doc_id long, source string, score double")
    return scored.withColumn("flagged", F.coalesce(F.col("score") >= F.lit(model.threshold), F.lit(False)))


def rates(scored: DataFrame) -> DataFrame:
    """Per source: pages, flagged pages and their share. Pages without a source form a group of their own."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("flagged").cast("long")).alias("flagged_pages"),
        F.avg(F.col("flagged").cast("double")).alias("rate"))
