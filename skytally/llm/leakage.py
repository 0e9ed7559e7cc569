"""Problem 7: evaluation passages that stand, fully or partly, in the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.fmindex import FMIndex
from skytally.llm.pages import PAGE_END, fold, line_edges, reading_order, symbol_table

#: Consecutive words of a passage that make a case.
MIN_WORDS = 12
#: Symbols of a searched phrase.
SEED = 8
#: A pair goes to alignment if it has so many hits and so many of some MIN_WORDS consecutive words are mostly covered by them.
LEAST_HITS, SUPPORTED = 16, 9
#: On a page where passages were found, a further one must have so many hits that they don't explain, unless it shares MIN_WORDS words with one of them.
OWN_HITS = 12
#: Symbols per index.
SHARD_SYMBOLS = 1_000_000
#: Passages are searched in blocks of at most so many characters; each block is one broadcast and one scan.
BLOCK_CHARS = 4_000_000
#: First sentences that so many items share are task lines.
TASK_LINE_ITEMS = 3

#: Share of a word's symbols that must be matched for the word to count as shown.
MIN_SHOWN = 0.65
#: Symbols around the supported words of a passage and around a phrase hit of a page that are aligned, at first and in full,
FIRST_MARGINS, MARGINS = (4, 32), (48, 48)
#: and the longest stretch, in passages, aligned at once.
STRETCH = 24
#: Page symbols per block of the jump rule; all jumps that long or longer are found, and shorter ones don't pay.
BLOCK = 8
#: Cells of a row of the score tables that are filled together; such rows stay in a core's cache.
CELLS = 200_000
MATCH, MISMATCH, GAP, ADVERT = 2, -3, 3, 40
#: From so many symbols on a stretch between words is an advert, since a jump is then cheaper than gaps.
LEAST_ADVERT = ADVERT // GAP + 1
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_WORD = re.compile(r"\S+")


def passages(items: DataFrame) -> DataFrame:
    """(item_id, passage): the text without a shared task line before it and a question after it."""
    parts = items.where("item_id is not null and text is not null").select(
        "item_id", F.split(F.trim("text"), r"(?<=[.?!])\s+").alias("s"))
    first = parts.groupBy(F.col("s")[0].alias("head")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TASK_LINE_ITEMS)
    parts = parts.join(first, parts["s"][0] == first["head"], "left")
    parts = parts.withColumn("s", F.when(F.col("head").isNotNull() & (F.size("s") > 1), F.slice("s", F.lit(2), F.size("s"))).otherwise(F.col("s")))
    last = F.element_at("s", -1)
    parts = parts.withColumn("s", F.when(last.endswith("?") & (F.size("s") > 1), F.slice("s", F.lit(1), F.size("s") - 1)).otherwise(F.col("s")))
    return parts.select("item_id", F.array_join("s", " ").alias("passage"))


class Passage:
    """Symbols of a passage with the word each belongs to."""

    def __init__(self, item_id: int, text: str, table: np.ndarray):
        self.items = [item_id]
        symbols, word, number = [], [], []
        for m in _WORD.finditer(text):
            s, _ = fold(m.group(), table)
            if len(s):
                symbols.append(s)
                word.append(len(s))
                number.append(any(c.isdigit() for c in m.group()))
        self.symbols = np.concatenate(symbols) if symbols else np.zeros(0, np.uint8)
        self.length = np.array(word, int)
        self.number = np.array(number, bool)
        self.word = np.repeat(np.arange(len(word)), word)
        self.starts = np.cumsum(self.length) - self.length
        raw = self.symbols.tobytes()
        cuts = [raw[a:a + n] for a, n in zip(self.starts, self.length)]
        #: Every MIN_WORDS consecutive words, by which passages that share some are told.
        self.runs = {hash(tuple(cuts[i:i + MIN_WORDS])) for i in range(len(cuts) - MIN_WORDS + 1)}


class PhraseBook:
    """Every SEED-symbol phrase of a block of passages."""

    def __init__(self, rows: list[tuple[int, str]], table: np.ndarray):
        made: dict[tuple, Passage] = {}
        for i, t in rows:
            p = Passage(i, t, table)
            if len(p.length) >= MIN_WORDS and len(p.symbols) >= SEED:
                same = made.setdefault((p.symbols.tobytes(), p.length.tobytes()), p)  # items with one passage are searched as one
                if same is not p:
                    same.items.append(i)
        self.passages = list(made.values())
        self.symbols = np.array([len(p.symbols) for p in self.passages], int)
        self.words = np.array([len(p.length) for p in self.passages], int)
        self.first_word = np.cumsum(self.words) - self.words
        self.word_start = np.concatenate([p.starts for p in self.passages]) if self.passages else np.zeros(0, int)
        self.word_length = np.concatenate([p.length for p in self.passages]) if self.passages else np.zeros(0, int)
        windows, owner, offset = [], [], []
        for k, p in enumerate(self.passages):
            w = np.lib.stride_tricks.sliding_window_view(p.symbols, SEED)
            windows.append(w)
            owner.append(np.full(len(w), k))
            offset.append(np.arange(len(w)))
        if windows:
            self.patterns, inverse = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            self.owner, self.offset = np.concatenate(owner)[order], np.concatenate(offset)[order]
            self.first = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.patterns)))])
        else:
            self.patterns, self.owner, self.offset = np.zeros((0, SEED), np.uint8), np.zeros(0, int), np.zeros(0, int)
            self.first = np.zeros(1, int)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Best local alignment of passage symbols to page symbols, for many pairs at once; a stretch of the page, such as an advert, may be jumped over.

    Returns for each pair the page position that each passage symbol is matched to, or -1.
    """
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while order:
        n = len(pairs[order[-1]][1])
        take = 0
        for k in reversed(order):
            if take and ((take + 1) * n > CELLS or 2 * len(pairs[k][1]) < n):
                break
            take += 1
        chosen, order = order[len(order) - take:], order[:len(order) - take]
        for k, at in zip(chosen, _align_batch([pairs[k] for k in chosen], max(len(pairs[k][0]) for k in chosen), n)):
            out[k] = at[:len(pairs[k][0])]
    return out


def _align_batch(pairs: list[tuple[np.ndarray, np.ndarray]], m: int, n: int) -> np.ndarray:
    count = len(pairs)
    n = -(-n // BLOCK) * BLOCK
    p, t = np.zeros((m, count), np.uint8), np.full((n, count), PAGE_END, np.uint8)  # what fills up matches nothing
    for k, (x, y) in enumerate(pairs):
        p[:len(x), k], t[:len(y), k] = x, y
    kind = np.int16 if ADVERT + MATCH * m < 30_000 else np.int32
    # eight apart, so that the exclusive or of two symbols is 0 or at least MATCH - MISMATCH
    p_wide, t_wide = p.astype(kind) * 8, t.astype(kind) * 8
    h = np.zeros((m + 1, n + 1, count), kind)  # pairs lie side by side, so that shifts along a page are whole stretches of memory
    a = np.empty((n + 1, count), kind)
    # whole arrays, as a minimum or maximum with a single number is many times slower
    none, most = np.zeros((n + 1, count), kind), np.full((n, count), MATCH - MISMATCH, kind)
    gap, advert = kind(GAP), kind(ADVERT)
    for i in range(m):
        prev, row = h[i], h[i + 1]
        np.bitwise_xor(t_wide, p_wide[i], out=a[1:])
        np.minimum(a[1:], most, out=a[1:])
        np.subtract(prev[:-1], a[1:], out=row[1:])
        np.add(row[1:], kind(MATCH), out=row[1:])
        np.subtract(prev, gap, out=a)
        np.maximum(row, a, out=row)
        np.maximum(row, none, out=row)
        for s in (1, 2, 4):  # gaps of up to 7 at once
            np.subtract(row[:-s], kind(GAP * s), out=a[s:])
            np.maximum(row[s:], a[s:], out=row[s:])
        # a jump over a block's length or more: best score of all blocks before
        best = row[:-1].reshape(n // BLOCK, BLOCK, count)
        while best.shape[1] > 1:
            half = best.shape[1] // 2
            best = np.maximum(best[:, :half], best[:, half:])
        best = np.maximum.accumulate(best[:, 0], axis=0)
        ahead = row[BLOCK:-1].reshape(n // BLOCK - 1, BLOCK, count)
        np.maximum(ahead, (best[:-1] - advert)[:, None, :], out=ahead)
    at = np.full((count, m), -1)
    i = h.max(axis=1).argmax(axis=0)
    for k, y in enumerate(i.tolist()):
        x = int(h[y, :, k].argmax())
        mine, page, back = p[:, k].tolist(), t[:, k].tolist(), [-1] * m
        v = h.item(y, x, k)
        while x > 0 and y > 0 and v > 0:
            same = mine[y - 1] == page[x - 1]
            corner = h.item(y - 1, x - 1, k)
            if v == corner + (MATCH if same else MISMATCH):
                if same:
                    back[y - 1] = x - 1
                y, x, v = y - 1, x - 1, corner
            elif v == h.item(y - 1, x, k) - GAP:
                y, v = y - 1, v + GAP
            elif v == h.item(y, x - 1, k) - GAP:
                x, v = x - 1, v + GAP
            else:  # a jump: back to the best score further left
                from_ = np.flatnonzero(h[y, :x, k] == v + ADVERT)
                if not len(from_):
                    break
                x, v = int(from_[-1]), v + ADVERT
        at[k] = back
    return at


def longest_run(passage: Passage, at: np.ndarray) -> tuple[int, int, int]:
    """(words, first and last passage word) of the longest stretch of words that the page shows.

    A word is shown if MIN_SHOWN of its symbols are matched and the page has about as much
    room for it as it is long: its room runs from the word before it to the one after it,
    adverts aside. One of a letter or two, which a single misreading hides, is also shown if
    just room for it lies between shown neighbours. Numbers, in which passages of one mould
    differ, must be matched in every digit or, of two digits at most, be lost without trace.
    """
    n = len(passage.length)
    hit = np.bincount(passage.word, weights=at >= 0, minlength=n)
    need = np.where(passage.length <= 2, passage.length, np.where(passage.length == 3, 2, np.ceil(MIN_SHOWN * passage.length - 1e-9)))
    need = np.where(passage.number, passage.length, need)
    known = np.flatnonzero(at >= 0)
    first, last = np.full(n, 1 << 40), np.full(n, -1)
    np.minimum.at(first, passage.word[known], at[known])
    np.maximum.at(last, passage.word[known], at[known])
    before = np.concatenate([[-1], np.maximum.accumulate(last)[:-1]])
    after = np.concatenate([np.minimum.accumulate(first[::-1])[::-1][1:], [1 << 40]])
    some = last >= 0
    gaps = [np.where((g < 0) | (g >= LEAST_ADVERT) | ~edge, 0, g) for g, edge in ((first - before - 1, before >= 0), (after - last - 1, after < 1 << 40))]
    room = np.where(some, last - first + 1, 0) + gaps[0] + gaps[1]
    shown = (hit >= need) & (room <= passage.length + 2 + passage.length // 5)
    for k in np.flatnonzero(~shown[1:-1] & (passage.length[1:-1] <= 2) & shown[:-2] & shown[2:]) + 1:
        left = first[k + 1] - last[k - 1] - 1
        if left <= (0 if passage.number[k] else passage.length[k] + 1):
            shown[k] = True
    best, best_end, run = 0, -1, 0
    for k, s in enumerate(shown):
        run = run + 1 if s else 0
        if run > best:
            best, best_end = run, k
    return best, best_end - best + 1, best_end


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of first[i], first[i] + 1, ... size[i] of them, for all i laid end to end."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size - first, size)


def _supported(book: PhraseBook, owner: np.ndarray, starts: np.ndarray, stops: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs of a page and passage ``owner`` with hits starts:stops are supported, and first and last symbol of the words that support them.

    Support is a window of MIN_WORDS words of which phrase hits mostly cover SUPPORTED.
    """
    symbols, words = book.symbols[owner], book.words[owner]
    base = np.cumsum(symbols) - symbols
    covered = np.zeros(int(symbols.sum()), bool)
    which, row = _spans(starts, stops - starts)
    covered[((base[which] + offset[row])[:, None] + np.arange(SEED)).ravel()] = True
    which, word = _spans(book.first_word[owner], words)
    first, length = base[which] + book.word_start[word], book.word_length[word]
    mostly = np.add.reduceat(covered, first, dtype=np.int32) * 2 >= length
    c = np.concatenate([[0], np.cumsum(mostly)])
    at, start = _spans(np.cumsum(words) - words, words - MIN_WORDS + 1)
    good = np.flatnonzero(c[start + MIN_WORDS] - c[start] >= SUPPORTED)
    pairs, begin = np.unique(at[good], return_index=True)
    end = np.concatenate([begin[1:], [len(good)]]) - 1
    last = start[good[end]] + MIN_WORDS - 1 if len(good) else begin
    return pairs, first[start[good[begin]]] - base[pairs], first[last] + length[last] - 1 - base[pairs]


def search_shard(book: PhraseBook, pages: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, np.ndarray]]:
    """(page, item, words, matched symbols of the page) of every case in one shard."""
    lengths = np.array([len(s) + 1 for _, s in pages])
    ends = np.cumsum(lengths)
    stop = np.full(1, PAGE_END, np.uint8)
    index = FMIndex(np.concatenate([x for _, s in pages for x in (s, stop)]))
    which, position = index.locate(*index.search(book.patterns))
    # a phrase stands in several passages: one hit each
    counts = book.first[which + 1] - book.first[which]
    row = np.repeat(np.arange(len(which)), counts)
    entry = book.first[which][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner, offset, position = book.owner[entry], book.offset[entry], position[row]
    page = np.searchsorted(ends, position, side="right")
    many = len(book.passages)
    pair = page.astype(np.int64) * many + owner
    order = np.lexsort((position, pair))
    pair, offset, position = pair[order], offset[order], position[order]
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
    stops = np.concatenate([starts[1:], [len(pair)]])
    enough = np.flatnonzero(stops - starts >= LEAST_HITS)
    if not len(enough):
        return []
    starts, stops = starts[enough], stops[enough]
    owners, page_of = pair[starts] % many, pair[starts] // many
    some, a, b = _supported(book, owners, starts, stops, offset)
    waiting: dict[int, list[tuple]] = {}
    for x, first, last in sorted(zip(some.tolist(), a.tolist(), b.tolist()), key=lambda w: starts[w[0]] - stops[w[0]]):  # most hits first
        page_no, at, off = int(page_of[x]), position[starts[x]:stops[x]], offset[starts[x]:stops[x]]
        waiting.setdefault(page_no, []).append((page_no, book.passages[int(owners[x])], at - (ends[page_no] - lengths[page_no]), off, first, last))
    # each page's likeliest passage goes first, since those that merely resemble it need no look once it is found
    cases: dict[int, list[tuple[Passage, int, np.ndarray]]] = {}
    for wave in (slice(0, 1), slice(1, 2), slice(2, None)):
        open_ = [c for w in waiting.values() for c in w[wave] if _own(c, cases.get(c[0], []))]
        for c, words, used in _whole(open_ if wave.start == 0 else _near(open_, pages), pages):
            cases.setdefault(c[0], []).append((c[1], words, used))
    return [(page_no, item, words, used) for page_no, found in cases.items() for passage, words, used in _apart(found) for item in passage.items]


def _own(candidate: tuple, cases: list) -> bool:
    _, passage, at, off, a, b = candidate
    if not cases or any(passage.runs & c[0].runs for c in cases):
        return True
    return len(np.setdiff1d(at[(off >= a) & (off < b)], np.concatenate([c[2] for c in cases]))) >= OWN_HITS


def _near(candidates: list[tuple], pages: list[tuple[int, np.ndarray]]) -> list[tuple]:
    """The candidates that show MIN_WORDS words where they are supported; nowhere else could they."""
    near = []
    for page_no, passage, at, off, a, b in candidates:
        inside = (off >= a) & (off + SEED <= b + 1)
        near.append((page_no, passage, at[inside], max(0, a - FIRST_MARGINS[0]), min(len(passage.symbols), b + 1 + FIRST_MARGINS[0]), FIRST_MARGINS[1]))
    return [c for c, (words, _) in zip(candidates, _judge(near, pages)) if words >= MIN_WORDS]


def _whole(candidates: list[tuple], pages: list[tuple[int, np.ndarray]]) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """The candidates that show MIN_WORDS words, with their longest stretch."""
    full = []
    for page_no, passage, at, off, a, b in candidates:
        a, b = max(0, a - MARGINS[0]), min(len(passage.symbols), b + 1 + MARGINS[0])
        full.append((page_no, passage, at[(off >= a) & (off + SEED <= b)], a, b, MARGINS[1]))
    for c, (words, used) in zip(candidates, _judge(full, pages)):
        if words >= MIN_WORDS:
            yield c, words, used


def _judge(tries: list[tuple[int, Passage, np.ndarray, int, int, int]], pages: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """(words, the page's matched symbols) of the longest stretch of each passage on its page.

    tries: page, passage, rising page places of its hits, first and end symbol of the passage
    to align, margin. A page is aligned around the hits only; what lies between them counts
    as an advert, however long it is. Hits that fill more than STRETCH passages are taken in
    overlapping stretches.
    """
    todo, back = [], []
    apart = np.full(LEAST_ADVERT, -1)
    for no, (page_no, passage, at, p0, p1, margin) in enumerate(tries):
        symbols = pages[page_no][1]
        lo, hi = np.maximum(at - margin, 0), np.minimum(at + SEED + margin, len(symbols))
        begins = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
        places = np.concatenate([x for i, j in zip(begins, [*begins[1:], len(at)]) for x in (np.arange(lo[i], hi[j - 1]), apart)])
        text = np.where(places >= 0, symbols[places], PAGE_END).astype(np.uint8)  # nothing in a passage matches a page's end
        longest = max(1, STRETCH * len(passage.symbols))
        for a in range(0, max(1, len(text) - longest // 2), max(1, longest // 2)):
            todo.append((passage.symbols[p0:p1], text[a:a + longest]))
            back.append((no, places[a:a + longest]))
    best: list = [(0, np.zeros(0, int))] * len(tries)
    for (no, places), found in zip(back, align(todo)):
        _, passage, _, p0, p1, _ = tries[no]
        matched = np.full(len(passage.symbols), -1)
        matched[p0:p1] = found
        words, w0, w1 = longest_run(passage, matched)
        if words > best[no][0]:
            used = matched[(passage.word >= w0) & (passage.word <= w1)]
            best[no] = words, places[used[used >= 0]]
    return best


def _apart(cases: list[tuple[Passage, int, np.ndarray]]) -> list[tuple[Passage, int, np.ndarray]]:
    """Drop a case whose symbols are mostly those of a longer case, unless the two passages share MIN_WORDS words."""
    kept: list[tuple[Passage, int, np.ndarray]] = []
    for c in sorted(cases, key=lambda c: (-c[1], c[0].items[0])):
        if all(c[0].runs & k[0].runs or len(np.intersect1d(c[2], k[2], assume_unique=True)) <= 0.5 * len(c[2]) for k in kept):
            kept.append(c)
    return kept


def _searcher(book: PhraseBook, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            hits = search_shard(book, [(d, s) for d, s, _, _ in pages])
            rows = []
            for page_no, item, words, used in hits:
                first, last = int(used.min()), int(used.max())
                doc_id, _, at, pieces = pages[page_no]
                # symbol -> sign of the reading-order text -> sign of the original text
                starts = np.cumsum([0] + [len(p) + 1 for _, p in pieces])
                places = []
                for k in range(np.searchsorted(starts, at[first], "right") - 1, np.searchsorted(starts, at[last], "right")):
                    origin, piece = pieces[k]
                    a, b = max(0, int(at[first] - starts[k])), min(len(piece), int(at[last] - starts[k]) + 1)
                    if b > a:
                        places.append({"first": origin + a, "stop": origin + b})
                rows.append((doc_id, item, words, places))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(list(cols[3]), pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))],
                ["doc_id", "item_id", "words", "places"])

        for batch in batches:
            for doc_id, text, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces = reading_order(text, edges)
                symbols, at = fold("\n".join(p for _, p in pieces), table)
                pages.append((doc_id, symbols, at, pieces))
                size += len(symbols)
                if size >= SHARD_SYMBOLS:
                    yield flush()
                    pages, size = [], 0
        if pages:
            yield flush()

    return run


OUT = "doc_id long, item_id long, words int, places array<struct<first: long, stop: long>>"


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pages that show at least MIN_WORDS consecutive words of an item's passage.

    Columns: doc_id, item_id, words (the longest stretch) and places, the stretches of
    ``text`` (first, stop; in characters) that hold it, one per line piece.

    Every shard of a partition gets an FM-index over its folded symbols; all SEED-symbol
    phrases of the passages are backward-searched in it at once, occurrences are located from
    sampled positions, and pairs with enough covered words are aligned symbol by symbol, so
    that scanning errors, broken words, columns and an advert in between don't hide a passage
    and replaced words do end one. Every item that the page shows is reported, also several
    over one place, if they share MIN_WORDS words or have one and the same passage; of
    passages that only resemble each other there, the longer one stays.

    Defined cases: null or empty texts hold nothing; null ids give no rows; unusable
    line_boxes leave the lines in their order; passages under MIN_WORDS words can't be found;
    repeated pages each count; a page and an item appear together once; an empty table gives
    no rows; other columns of the inputs are ignored. Texts are searched whole.
    """
    pages = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text", line_edges().alias("edges"))
    table = symbol_table()
    out = None
    for block in _blocks(passages(items)):
        part = pages.mapInArrow(_searcher(PhraseBook(block, table), table), OUT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pages.sparkSession.createDataFrame([], OUT)


def _blocks(rows: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of bounded size, in order of item."""
    block, size = [], 0
    for item_id, text in rows.orderBy("item_id", "passage").toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def removal_spans(leaks: DataFrame) -> DataFrame:
    """Stretches to cut from each page: the places of all its items, overlapping ones merged."""
    from pyspark.sql import Window

    flat = leaks.select("doc_id", F.inline("places")).distinct()
    w = Window.partitionBy("doc_id").orderBy("first", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (flat.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1).otherwise(0)).over(w))
            .groupBy("doc_id", "island").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("island"))
