"""Scanned pages: reading order and folding of what scanners confuse."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that scanning errors turn into each other share a symbol.
CONFUSED = ("eco0", "nu", "hb68", "ijl1tf", "as5", "rvy", "gq9", "m", "w", "d", "k", "p", "x", "z", "2", "3", "4", "7")
#: Symbol of a page's end. Symbols fit 5 bits.
PAGE_END = 31

#: Columns glued into one line stand apart by a bar or three blanks.
GLUED = re.compile(r" *\| *|\s{3,}")
#: Lines whose left edges differ by more than so many pixels are in different columns.
COLUMN_GAP = 60

ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
                        "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def symbol_table() -> np.ndarray:
    """Code point to symbol; 0 drops it."""
    table = np.zeros(65536, np.uint8)
    for k, signs in enumerate(CONFUSED, 1):
        for c in signs:
            table[ord(c)] = table[ord(c.upper())] = k
    for c in "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ":
        table[ord(c)] = table[ord(c.translate(ACCENTS))]
    table[ord("ſ")] = table[ord("s")]
    return table


def fold(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the signs that count and their offsets in ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table[np.minimum(codes, 65535)]
    at = np.flatnonzero(symbols)
    return symbols[at], at


def line_edges(boxes: str = "line_boxes") -> Column:
    """The left edge of each line, the only part of the boxes that reading order needs."""
    return F.transform(boxes, lambda b: b["x0"])


def reading_order(text: str, edges) -> list[tuple[int, str]]:
    """(offset in text, piece) in the order in which the page is to be read.

    Lines are taken column by column from their left edges; glued lines are cut and their
    pieces go to their columns. Without usable edges lines keep their order.
    """
    lines = text.split("\n")
    if "|" in text or "   " in text:
        columns: list[list[tuple[int, str]]] = []
        at, glued = 0, 0
        for line in lines:
            pos, k = 0, 0
            for m in GLUED.finditer(line):
                if m.start() > pos:
                    while len(columns) <= k:
                        columns.append([])
                    columns[k].append((at + pos, line[pos:m.start()]))
                if m.start() > 0:
                    k += 1
                    glued += 1
                pos = m.end()
            if pos < len(line):
                while len(columns) <= k:
                    columns.append([])
                columns[k].append((at + pos, line[pos:]))
            at += len(line) + 1
        if glued * 3 >= len(lines):
            return [p for c in columns for p in c]
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    pieces = list(zip(starts, lines))
    if edges is not None and len(edges) == len(lines) and len(lines) > 1:
        known = sorted(x for x in edges if x is not None)
        if known and known[-1] - known[0] > COLUMN_GAP:
            bounds = [b for a, b in zip(known, known[1:]) if b - a > COLUMN_GAP]
            if bounds:
                column = [sum(x >= b for b in bounds) if x is not None else 0 for x in edges]
                order = sorted(range(len(lines)), key=column.__getitem__)
                return [pieces[i] for i in order]
    return pieces
