"""Quality rules, line first: lines that fail are taken out, then documents that lose too much.

A line (``\\n``-split, with a word) fails as
  symbols      more than a tenth as many of ``#*$%&|<>`` as characters in words,
  shouting     three or more ``!`` and more than one for every four words,
  navigation   three or more of ``|`` and ``>``, more than one for every three words,
  fragment     fewer than three words and no closing punctuation,
  boilerplate  one of the fixed phrases below.
A document is kept unless a base rule fails (under 20 words, or more than 30 %
of its words in repeated 8-word windows) or its failed lines hold more than
``most_lost`` percent of its words.

Cases: null is an empty text; an empty text has 0 everywhere, fails the base
and is not kept; repeated rows count each; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm import blocks as B

#: Phrases of licence, legal and interface lines (lower case).
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up for",
)
#: Bytes that close a sentence, and the last bytes of closing marks beyond ASCII.
CLOSING = b".!?:;\"')]"
CLOSING_WIDE = ("…", "”", "’", "»", "。", "！", "？")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines_failed long, n_words_lost long, kept boolean"
TEXT_SCHEMA = SCHEMA + ", failed_lines array<long>, kept_text string"
_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(CLOSING)] = True


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _first_of_equal(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (group, key) rows: is it not the first of its kind; has its kind two rows or more."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    both = B.mix(keys ^ B.mix(groups.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    follows = np.zeros(len(keys), bool)
    follows[:-1] = same[1:]
    many[order] = same | follows
    return later, many


def measure(data: np.ndarray, offsets: np.ndarray, most_lost: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The columns of SCHEMA (without doc_id) for a block of documents; the documents and starts of failed lines."""
    n = len(offsets) - 1
    start, end, first = B.words(data, offsets)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first)
    code_points = _sums((data & 0xC0) != 0x80)
    chars = _sums(code_points[end] - code_points[start])
    symbols = _sums(_SYMBOL[data])

    # words in repeated 8-word windows of the same text
    ranges = B.Ranges(data)
    hashes = ranges.hash(start, end)
    repeat = np.zeros(len(start) + 1, np.int64)
    if len(start) >= 8:
        whole = np.flatnonzero(word_doc[7:] == word_doc[:-7])
        _, many = _first_of_equal(word_doc[whole], B.runs(hashes, whole, np.full(len(whole), 8)))
        np.add.at(repeat, whole[many], 1)
        np.add.at(repeat, whole[many] + 8, -1)
    repeated = _sums(np.cumsum(repeat)[:-1] > 0)

    # lines
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < offsets[-1]]
    # a \n that ends its text leaves an empty line, which has no word and needs no row
    line_end = np.append(line_start[1:], offsets[-1]) if len(line_start) else line_start
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    w0, w1 = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    worded = w1 > w0
    line_start, line_end, line_doc, w0, w1 = (x[worded] for x in (line_start, line_end, line_doc, w0, w1))
    content_end = np.where((line_end > line_start) & (data[line_end - 1] == 10), line_end - 1, line_end) if len(line_start) else line_end
    later, _ = _first_of_equal(line_doc, ranges.hash(line_start, content_end))
    words = w1 - w0
    bangs, bars = _sums(data == 33), _sums((data == 124) | (data == 62))
    n_sym, n_bang, n_bar = (x[line_end] - x[line_start] for x in (symbols, bangs, bars))
    last = end[w1 - 1] if len(w1) else w1
    closed = _CLOSE[data[last - 1]] if len(w1) else np.zeros(0, bool)
    for mark in CLOSING_WIDE:
        raw = mark.encode()
        hit = np.ones(len(last), bool)
        for k, byte in enumerate(reversed(raw)):
            hit &= (last - 1 - k >= line_start) & (data[np.maximum(last - 1 - k, 0)] == byte)
        closed = closed | hit
    stock = np.zeros(len(words), bool)
    low = B.LOWER[data].tobytes()
    for d in range(n):
        for m in _PHRASES.finditer(low, int(offsets[d]), int(offsets[d + 1])):
            stock[np.searchsorted(line_start, m.start(), "right") - 1] = True
    fails = (10 * n_sym > chars[w1] - chars[w0]) | ((n_bang >= 3) & (4 * n_bang > words)) | ((n_bar >= 3) & (3 * n_bar > words)) | ((words < 3) & ~closed) | stock
    per_doc = lambda values: np.bincount(line_doc, values, n).astype(np.int64)
    lost = per_doc(words * fails)
    n_repeat = repeated[first[1:]] - repeated[first[:-1]]
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    columns = {
        "n_words": n_words,
        "word_chars": chars[first[1:]] - chars[first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": per_doc(later),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "n_lines_failed": per_doc(fails),
        "n_words_lost": lost,
        "kept": ~base_failed & (100 * lost <= most_lost * n_words),
    }
    return columns, line_doc[fails], line_start[fails]


def without_lines(raw: bytes, starts: list[int]) -> tuple[list[int], str]:
    """Numbers (from 0) of the lines that start at ``starts``, and the text of the others."""
    numbers, at, n = [], 0, 0
    for start in starts:
        n += raw.count(b"\n", at, start)
        at = start
        numbers.append(n)
    gone = set(numbers)
    lines = raw.split(b"\n") if gone else [raw]
    return numbers, b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()


def judge(docs: DataFrame, most_lost: int = 40, text: bool = False) -> DataFrame:
    """Counts and verdict of every document, with ``text`` also TEXT_SCHEMA's; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(1))
            for lo, hi in B.blocks(offsets):
                block, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                part, failed_doc, failed_start = measure(block, bounds, most_lost)
                columns = {"doc_id": batch.column(0).slice(lo, hi - lo), **{k: pa.array(v) for k, v in part.items()}}
                if text:
                    first = np.searchsorted(failed_doc, np.arange(hi - lo + 1))
                    cleaned = [without_lines(block[bounds[d] : bounds[d + 1]].tobytes(), (failed_start[first[d] : first[d + 1]] - bounds[d]).tolist()) for d in range(hi - lo)]
                    columns["failed_lines"] = pa.array([c[0] for c in cleaned], pa.list_(pa.int64()))
                    columns["kept_text"] = pa.array([c[1] for c in cleaned], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TEXT_SCHEMA if text else SCHEMA)


def clean(docs: DataFrame, most_lost: int = 40) -> DataFrame:
    """(doc_id, text): the kept documents without their failed lines."""
    return judge(docs, most_lost, text=True).filter("kept").select("doc_id", F.col("kept_text").alias("text"))
