"""Quality rules, line first (operator 9).

Every line of a text is judged by itself: navigation (separator bars, link-like fragments),
punctuation (no sentence end, or nearly every word shouted) and boilerplate (fixed phrases, markup,
symbols that make up a large share of the line). Failing lines are removed; then the document is rejected if it lost more than
``max_lost`` of the characters of its words. Base counts over the whole text reject documents that
are too short or too repetitive whatever their lines look like.

Work is one map over the rows: nothing is shuffled, and memory is bounded by the longest text.

Defined cases: a null or empty text has no words and fails the base rule; blank lines are neither
judged nor removed; repeated rows are judged alike, each by itself; an empty table gives an empty
result; other columns of the input are ignored by ``judge`` and carried by ``clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import counted, map_texts, map_whole, texts, with_texts

#: ASCII white space, symbols that are counted, ends of sentences, separators.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
ENDS = tuple(".!?:;\"')]}…”»’。！？")
STOPS = (".", "!", "?", "…", "。")
BARS = frozenset("| » > « < • · / :: -> →".split())
BOILERPLATE = re.compile(
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|lorem ipsum"
    "|click here|sign up|log ?in to|subscribe (?:now|to our)|share this|read more|skip to (?:main )?content|powered by",
    re.IGNORECASE,
)
SYMBOL = re.compile("[#*$%&|<>]")
#: A line fails if more than one in this many of its characters is a symbol.
SYMBOL_SHARE = 8
MARKUP = re.compile(r"[{}]|</?[a-z]+[^<>]*>")

WORD = re.compile("[^\\x20\\x09-\\x0D]+").findall

WINDOW, LEAST_WORDS, MOST_REPEATED, MAX_LOST = 8, 20, 30, 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, chars_lost long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Rename pairs of names, doubling the span each time: exact, and linear passes of sorting.
    span, names = 1, ids
    while span < window:
        step = min(span, window - span)
        head, tail = names[: len(names) - step], names[step:]
        _, names = np.unique(head * (int(names.max()) + 1) + tail, return_inverse=True)
        span += step
    often = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fails(line: str) -> bool:
    """Whether a line with at least one word breaks a rule."""
    words = WORD(line)
    bars = sum(w in BARS for w in words)
    if bars >= 2 and bars * 6 >= len(words):
        return True
    if not words[-1].endswith(ENDS) and not (len(words) >= 10 and any(w.endswith(STOPS) for w in words)):
        return True  # a fragment; running prose whose end is cut off is none
    shouted = sum(w.endswith(("!!", "??")) for w in words)
    if shouted * 3 > len(words):
        return True
    if len(SYMBOL.findall(line)) * SYMBOL_SHARE > sum(map(len, words)):
        return True
    return len(words) <= 30 and bool(BOILERPLATE.search(line)) or len(MARKUP.findall(line)) * 5 > len(words)


def judged(text: bytes, max_lost: float = MAX_LOST) -> tuple[list[int], bool, bool, list[bool] | None]:
    """The counts of a text, whether the base rule fails it, whether it is kept, and its failing lines."""
    words = text.split()
    lines = text.split(b"\n")
    full = [bool(x.strip(SPACE)) for x in lines]
    seen: set[bytes] = set()
    again = 0
    for line, any_word in zip(lines, full, strict=True):
        if any_word:
            again += line in seen
            seen.add(line)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACE)))
    counts = [len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), again, repeated_words(words)]
    base = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
    fails = [any_word and line_fails(line.decode("utf-8", "replace")) for line, any_word in zip(lines, full, strict=True)]
    lost = sum(len(x.decode("utf-8", "replace").translate(_NO_SPACE)) for x, f in zip(lines, fails, strict=True) if f)
    return [*counts, sum(fails), lost], base, not base and lost <= max_lost * chars, fails


_NO_SPACE = dict.fromkeys(SPACE)


def judge(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Counts and verdict of each document."""

    def each(batch):
        ids, cols, flags = batch.column(0), [[] for _ in range(7)], [[], []]
        for text in texts(batch.column(1)):
            counts, base, kept, _ = judged(text, max_lost)
            for c, v in zip(cols, counts, strict=True):
                c.append(v)
            flags[0].append(base)
            flags[1].append(kept)
        arrays = [ids.cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(f, pa.bool_()) for f in flags), *(pa.array(c, pa.int64()) for c in cols[5:])]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_texts(docs, ["doc_id", "text"], each, SCHEMA)


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that are kept, with all their columns and without their failing lines."""

    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            out, keep = [], []
            for text in texts(batch.column(at)):
                _, _, kept, fails = judged(text, max_lost)
                keep.append(kept)
                if kept and any(fails):
                    text = b"\n".join(x for x, f in zip(text.split(b"\n"), fails, strict=True) if not f)
                out.append(text.decode("utf-8", "replace") if kept else None)
            yield with_texts(batch, at, out, n).filter(pa.array(keep, pa.bool_()))

    return counted(map_whole(docs, docs.columns, run), docs)
