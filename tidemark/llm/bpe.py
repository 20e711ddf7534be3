"""Byte-level BPE by corpus-level merge replay, and decoding (operator 3).

A block of texts is split by the pattern; its distinct words are the corpus that merges are
replayed on. An inverted index maps the rank of every mergeable pair to the word positions where it
stands. Ranks are taken in order; each one is applied to all its positions at once, and only the two
neighbours of a merged position enter the index again. A word is encoded once per task however
often it occurs, and the texts are then a gather over the encoded words.

A word may hold a pair more than once, and a merge may create a pair of a lower rank. Then only the
leftmost position of the word is merged in that step, and the others go back to the index behind the
lower rank, which is the order of encoding each word by itself.

Scale: one map over the rows; nothing is shuffled. The vocabulary (tens of thousands of entries) is
read by each worker from the public file; the block of texts and the store of words are bounded.

Defined cases: null is the empty text, which has no ids; every UTF-8 text round-trips, whatever its
length, controls and unassigned code points included; repeated rows are encoded alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text in a block, words that a worker remembers, and characters from which a text is split piece by piece.
BLOCK_BYTES, MOST_WORDS, LONG_TEXT = 6 << 20, 400_000, 1 << 20
NONE = np.int32(1 << 30)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Codec:
    """Encodes lists of distinct words by replaying all merges over them; decodes ids."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.concatenate([np.array(keys, np.int64)[order], [np.iinfo(np.int64).max]])
        self.pair_ranks = np.concatenate([np.array(values, np.int32)[order], [NONE]]).astype(np.int32)
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair of ids makes, NONE if it makes none."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        pair = np.full(n, NONE, np.int32)
        left = np.flatnonzero(nxt >= 0)
        pair[left] = self.rank_of(tok[left], tok[left + 1])
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        ranks: list[int] = []

        def file(at: np.ndarray, by: np.ndarray) -> None:
            """Enter positions in the index under their ranks."""
            if len(at) > 1:
                order = np.argsort(by, kind="stable")
                at, by = at[order], by[order]
                cuts = np.flatnonzero(by[1:] != by[:-1]) + 1
                bounds = [0, *cuts.tolist(), len(at)]
                heads = by[bounds[:-1]].tolist()
            else:
                bounds, heads = [0, len(at)], by.tolist()
            for k, r in enumerate(heads):
                if r not in index:
                    heapq.heappush(ranks, r)
                index[r].append(at[bounds[k] : bounds[k + 1]])

        live = left[pair[left] < NONE]
        if len(live):
            file(live, pair[live])
        while ranks:
            r = heapq.heappop(ranks)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[pair[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at, again = self._together(np.unique(at), r, tok, nxt, prv, word)
                if len(again):
                    index[r].append(again)
                    heapq.heappush(ranks, r)
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = r
            tok[gone] = -1
            pair[gone] = NONE
            pair[at] = NONE
            nxt[at] = after
            right = after >= 0
            prv[after[right]] = at[right]
            before = prv[at]
            leftward = before >= 0
            lefts, rights = before[leftward], at[right]
            both = np.concatenate([lefts, rights])
            if len(both):
                made = self.rank_of(tok[both], tok[nxt[both]])
                pair[both] = made
                some = made < NONE
                if some.any():
                    file(both[some], made[some])
        alive = tok >= 0
        return tok[alive], np.bincount(word[alive], minlength=len(words))

    def _together(self, at: np.ndarray, r: int, tok: np.ndarray, nxt: np.ndarray, prv: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted positions of rank ``r``, those to merge at once, and those to come back to.

        Of overlapping positions every other one is merged, from the left. Where a merge would bring up a
        lower rank on either side, its word merges its leftmost position only.
        """
        order = np.arange(len(at))
        linked = np.zeros(len(at), bool)
        np.equal(nxt[at[:-1]], at[1:], out=linked[1:])
        take = (order - np.maximum.accumulate(np.where(linked, 0, order))) & 1 == 0
        own = word[at]
        p = at[take]
        if (own[take][1:] != own[take][:-1]).all():
            return p, at[:0]
        gone = nxt[p]
        low = np.zeros(len(p), bool)
        after = nxt[gone]
        some = after >= 0
        low[some] = self.rank_of(np.full(some.sum(), r), tok[after[some]]) < r
        before = prv[p]
        some = before >= 0
        left = np.where(np.isin(before, gone), r, tok[before])
        low[some] |= self.rank_of(left[some], np.full(some.sum(), r)) < r
        if not low.any():
            return p, at[:0]
        wait = np.isin(own, own[take][low])
        first = np.ones(len(at), bool)
        np.not_equal(own[1:], own[:-1], out=first[1:])
        return at[take & ~wait | first & wait], at[wait & ~first]

    def _pieces(self, text: str):
        """Matches of a long text, some at a time."""
        found = (m[0] for m in self.pattern.finditer(text))
        while part := list(islice(found, 1 << 16)):
            yield part

    def encode_block(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        number, split = self.number, self.split
        if len(number) > MOST_WORDS:
            self.forget()
            number = self.number
        known = len(number)
        parts, counts = [], []
        for text in block:
            n = len(parts)
            for found in [split(text)] if len(text) < LONG_TEXT else self._pieces(text):
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)))
            counts.append(sum(map(len, parts[n:])))
        if len(number) > known:
            fresh = [w.encode("utf-8", "replace") for w in list(number)[known:]]
            ids, sizes = self.replay(fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        used = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        out, sizes = gather(self.ids, self.offsets[used], self.offsets[used + 1] - self.offsets[used])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return out, bounds[ends] - bounds[ends - np.array(counts, np.int64)]

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts one after another, and how many each has."""
        out, sizes = gather(self.flat, self.starts[ids], self.lengths[ids])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return out, bounds[ends] - bounds[ends - counts]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``flat[start : start + length]`` one after another."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return flat[np.repeat(shift, lengths) + np.arange(total)], lengths


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a vocabulary file, kept by the worker."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key = (path or vocabulary_path(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(key[0]), rust_pattern(pattern))
    return _CODECS[key]


def rust_pattern(pattern: str) -> str:
    """The pattern with white space as the Unicode property, which leaves out the separators 1C to 1F."""
    space = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{space}]+(?![^{space}])|[{space}]+")


def blocks(column: list[bytes], most: int = BLOCK_BYTES):
    """Ranges of texts of a bounded size together, one text at least."""
    start = held = 0
    for i, t in enumerate(column):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(column):
        yield start, len(column)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids, column = batch.column(0), texts(batch.column(1))
            for a, b in blocks(column):
                flat, counts = own.encode_block([t.decode("utf-8", "replace") for t in column[a:b]])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, data binary)``: the bytes of every row's ids."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                each = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                out, sizes = own.decode_block(np.concatenate(each), np.array([len(x) for x in each], np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_cut(out, sizes), pa.binary())], names=["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def _cut(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = flat.tobytes(), np.cumsum(sizes) * flat.itemsize
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(sizes) else []


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token count, hash of the ids and hash of what they decode to, in one pass over the texts."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            doc_ids, column = batch.column(0), texts(batch.column(1))
            for a, b in blocks(column):
                flat, counts = own.encode_block([t.decode("utf-8", "replace") for t in column[a:b]])
                back, sizes = own.decode_block(flat.astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[a:b],
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in _cut(flat.astype("<u4"), counts)], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in _cut(back, sizes)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
