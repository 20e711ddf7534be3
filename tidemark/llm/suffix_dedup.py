"""Removal of long repeated strings over sorted suffixes (operator 8).

Wanted: every byte covered by a ``SPAN``-byte string that starts at two places or more. Sorting a
suffix per byte would multiply the corpus by the span, so suffixes are taken at anchors only. The anchor of a
string is the leftmost of its places whose hashed ``GRAM`` bytes are the least: equal strings have their
anchors at equal offsets, so a repeated string always shows up as two anchors with equal grams, d equal
bytes before them and ``REST - d`` equal bytes after the gram, d being the offset. An anchor knows the
range of offsets at which it is the anchor; the bytes that these strings hold are its context. Each start of a string
belongs to one anchor. Nothing is lost.

1. A string that equals the one p bytes before it (p at most ``REST``: runs of one pattern) is repeated as it stands;
   it needs no anchor, since the first string of the run stands for it elsewhere. Runs of any length thus cost two spans.
2. Anchors are counted by gram hash; grams that occur once, most of them, cannot be part of a match.
3. Anchors of repeated grams carry the hash of their context. A context that occurs twice is repeated as
   a whole. Copies thereby shrink to one representative.
4. Contexts whose gram occurs in other contexts too are fetched once as text. Sorted by the reversed bytes before the gram, their
   neighbours tell how many of these any other context shares; the rest is cut off. Then they are range-partitioned by
   their leading tokens: the whole suffix from the anchor on, then the reversed bytes before it (splitters are Spark's
   sample of them), so a gram with very many contexts is parted as well. A bucket is worked off in
   chunks, which sort their suffixes, and the reversed prefixes, by multikey quicksort on 8-byte tokens, where only
   runs that are still equal meet their next token, and keep the common lengths of neighbours. Rows
   that fall in one class of both orders for some d share a string. Since all strings at an anchor hold its
   gram, the largest and the smallest such d bound what is covered.
5. Across boundaries: what a row has in common with any row beyond its chunk is no more than what it has in common with the
   chunk's first or last row. Rows whose common part is long enough for some d hand on that string, once per class,
   as a 128-bit hash; hashes are counted over all chunks, and single ones learn of the others.
6. Covered ranges go back to their documents.

Contexts of one gram are taken for copies of each other by 64-bit hashes, strings across boundaries by 128-bit ones: two
different contexts of one gram are mistaken with a probability of 2 ** -64 a pair.

Memory: a text is scanned in blocks of ``BLOCK`` bytes, and what is kept of it is its anchors and ranges.

Defined cases: null and empty texts, and texts shorter than the span, lose nothing; matches never
cross documents, and may overlap inside one; repeated rows repeat each other whole; rows with a null id
are treated like others (a row is known by its id and a 64-bit hash of its text, without an id by two such hashes; rows
that share these have equal texts and lose the same); an empty table gives an empty result; other columns are ignored by
``digest_report``, carried by ``remove_repeats``, which keeps a character unless all its bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, fresh, map_texts, map_whole, own_columns, release, stored, texts, with_texts

SPAN, GRAM, CHUNK, BLOCK = 200, 64, 16_384, 1 << 19
REST = SPAN - GRAM
#: Bits of a key that hold a place within a block, and how many equal grams ahead a period is looked for.
PLACE, LAGS = np.uint64((1 << 20) - 1), 8

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, by doubling."""
    h, factor, span = _TABLE[data], 0x9E3779B97F4A7C15, 1
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor, span = factor * factor % (1 << 64), span * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over each run of ``width`` values."""
    span, out = 1, values
    while span * 2 <= width:
        out, span = of(out[:-span], out[span:]), span * 2
    n = len(values) - width + 1
    return of(out[:n], out[width - span : width - span + n]) if span < width else out


_PLACES = np.arange(BLOCK + SPAN, dtype=np.uint64)


def _periods(at: np.ndarray, h: np.ndarray, lag: int) -> list[int]:
    """Distances of at most ``REST`` between anchors with equal grams that are ``lag`` apart, ascending."""
    gap = at[lag:] - at[:-lag]
    gap[(gap > REST) | (h[at[lag:]] != h[at[:-lag]])] = 0
    return np.flatnonzero(np.bincount(gap, minlength=1)[1:]).tolist()


def _runs(data: np.ndarray, period: int) -> list[tuple[int, int]]:
    """Stretches of at least ``SPAN + period`` bytes that repeat what stands a period before: first byte and end."""
    if len(data) < SPAN + period:
        return []
    breaks = np.concatenate([[-1], np.flatnonzero(data[:-period] != data[period:]), [len(data) - period]])
    long = np.flatnonzero(np.diff(breaks) > SPAN)
    return [(int(breaks[k]) + 1, int(breaks[k + 1]) + period) for k in long]


def anchors(data: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Places, gram hashes, largest and smallest offset of each anchor; byte ranges of runs, which are repeated as they stand."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    runs: list[tuple[int, int]] = []
    for begin in range(0, len(data) - SPAN + 1, block):
        n = min(block, len(data) - SPAN + 1 - begin)  # strings that start in this block
        h = gram_hashes(data[begin : begin + n + SPAN - 1])
        key = (h & ~PLACE) | _PLACES[: len(h)]
        place = (_slide(key, REST + 1, np.minimum) & PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        at, last = place[first], np.append(first[1:], n) - 1
        skip = np.zeros(n, bool)
        early = max(0, begin - REST)
        for lag in range(1, LAGS + 1):
            if len(at) <= lag or lag == 1 and len(np.unique(h[at])) == len(at):
                break
            for p in (k + 1 for k in _periods(at, h, lag)):
                for a, b in _runs(data[early : begin + n + SPAN - 1], p):
                    runs.append((early + a, early + b))
                    skip[max(0, early + a + p - begin) : max(0, early + b - SPAN + 1 - begin)] = True
            live = ~(skip[first] & skip[last])
            first, last, at = first[live], last[live], at[live]
        if skip.any():
            live = np.flatnonzero(~skip)
            place = place[live]
            first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])[: len(live)]
            at, first, last = place[first], live[first], live[np.append(first[1:], len(live))[: len(live)] - 1]
        for column, value in zip(out, (at + begin, h[at].view(np.int64), at - first, at - last), strict=True):
            column.append(value)
    if not out[0]:
        return *(np.zeros(0, np.int64) for _ in range(4)), []
    return *(np.concatenate(x) for x in out), merged(runs)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that ranges cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _identity() -> tuple[Column, Column]:
    """A row's id, or where it has none a hash of its text, and another hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("id"), text)), F.xxhash64(text)


def keyed(docs: DataFrame) -> DataFrame:
    """``(text, doc, key, doc_id)`` of each row."""
    doc, key = _identity()
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), doc.alias("doc"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"))


OCCURRENCES = (("h", np.int64), ("c", np.int64), ("doc", np.int64), ("key", np.int64), ("at", np.int32), ("hi", np.int16), ("lo", np.int16), ("end", np.int32))


def _occurrences(rows: DataFrame) -> DataFrame:
    """A row per anchor with its context's hash, its ``end`` being -1, and a row from ``at`` to ``end`` per run."""

    def each(batch):
        out: list[list] = [[] for _ in OCCURRENCES]

        def put(*columns):
            for column, value in zip(out, columns, strict=True):
                column.append(value)

        for text, doc, key in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at, h, hi, lo, runs = anchors(np.frombuffer(text, np.uint8))
            if len(at):
                bounds = zip((at - hi).tolist(), (at - lo + SPAN).tolist(), hi.tolist(), strict=True)
                c = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b], d) for a, b, d in bounds), np.uint64, len(at)).view(np.int64)
                put(h, c, np.full(len(at), doc), np.full(len(at), key), at, hi, lo, np.full(len(at), -1))
            if runs:
                begin, end = np.array(runs, np.int64).T
                # Runs meet no gram; their keys only spread them.
                spread = ((begin + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % (1 << 64))).view(np.int64)
                none = np.zeros(len(begin), np.int64)
                put(spread, none, np.full(len(begin), doc), np.full(len(begin), key), begin, none, none, end)
        if out[0]:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kind)) for x, (_, kind) in zip(out, OCCURRENCES, strict=True)], names=[name for name, _ in OCCURRENCES])

    return map_texts(rows, ["text", "doc", "key"], each, "h long, c long, doc long, key long, at int, hi short, lo short, end int", 0)


def _gram_counts(rows: DataFrame) -> DataFrame:
    def each(batch):
        found = [h for t in texts(batch.column(0)) if len(h := anchors(np.frombuffer(t, np.uint8))[1])]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return map_texts(rows, ["text"], each, "h long, n long", 0)


def multikey_order(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order within ascending groups, and common bytes of each row with the one before it (-1 where a group begins).

    Multikey quicksort over 64-bit tokens: each pass sorts by one token only the runs that are equal so far.
    """
    n, depth = words.shape
    order, run = np.arange(n), group.copy()
    common = np.full(n, 8 * depth, np.int64)
    common[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))] = -1
    live = np.arange(n)
    for k in range(depth):
        r = run[live]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        number = np.cumsum(new) - 1
        live = live[np.bincount(number)[number] > 1]
        if not len(live):
            break
        r, rows = run[live], order[live]
        token = words[rows, k]
        by = np.lexsort((token, r))
        order[live], token = rows[by], token[by]
        same = r[1:] == r[:-1]
        parted = same & (token[1:] != token[:-1])
        gap = token[1:][parted] ^ token[:-1][parted]
        common[live[1:][parted]] = 8 * k + sum((gap < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
        run[live] = np.concatenate([[0], np.cumsum(~same | parted)])
    return order, common


def resolve(group: np.ndarray, left: list[bytes], right: list[bytes], weight: np.ndarray, before: bool = False, beyond: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Largest and smallest d of a repeated string per context, -1 where there is none; and strings that rows beyond may hold.

    ``group``: ascending numbers of equal grams; ``left``: reversed bytes before the gram; ``right``: bytes after it, ascending within
    a gram; ``weight``: occurrences; ``before``, ``beyond``: whether rows that precede the first or follow the last one may have its
    gram. The strings are (row, d, occurrences up to two), one for each class of equal ones.
    """
    n = len(group)
    had, has = np.array([len(x) for x in left]), np.array([len(x) for x in right])

    def tokens(parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(x.ljust(REST, b"\0") for x in parts), np.uint8).reshape(n, REST).view(">u8").astype(np.uint64)

    classes = []
    for parts in (right, left):
        order, common = multikey_order(tokens(parts), group)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        classes.append((back, common))
    (back_r, common_r), (back_l, common_l) = classes
    # Common bytes with the first and the last row bound those with what is beyond them.
    reach = np.full(n, -1)
    if before:
        size = int(np.searchsorted(group, group[0], "right"))
        reach[:size] = np.minimum.accumulate(np.concatenate([[REST], common_r[1:size]]))
    if beyond:
        size = n - int(np.searchsorted(group, group[-1]))
        ahead = np.minimum.accumulate(np.concatenate([[REST], common_r[n - size + 1 :][::-1]]))[::-1]
        reach[n - size :] = np.maximum(reach[n - size :], ahead)
    # Right bytes that no other row of the gram has take no part; of the first and the last row it is not known.
    ahead = np.append(np.maximum(common_r[1:], -1), -1)
    shared = np.maximum(np.maximum(common_r, ahead), 0)
    shared[0] = REST if before else shared[0]
    shared[-1] = REST if beyond else shared[-1]
    reach, has = reach[back_r], np.minimum(has, shared[back_r])
    most, least, far = np.full(n, -1), np.full(n, SPAN), []
    heavy = np.minimum(weight, 2)
    for d in range(REST + 1):
        fit = np.flatnonzero((had >= d) & (has >= REST - d))
        if not len(fit):
            continue
        pair = np.cumsum(common_r < REST - d)[back_r[fit]] * (n + 1) + np.cumsum(common_l < d)[back_l[fit]]
        _, one, name = np.unique(pair, return_index=True, return_inverse=True)
        held = np.bincount(name, heavy[fit])
        hit = fit[held[name] >= 2]
        most[hit] = d
        least[hit] = np.minimum(least[hit], d)
        for k in np.flatnonzero(reach[fit[one]] >= REST - d).tolist():
            far.append((int(fit[one[k]]), d, int(min(held[k], 2))))
    return most, np.where(most < 0, -1, least), far


RESOLVED = "h long, c long, most short, least short, s binary, n int"


def _left_bounded(contexts: DataFrame, chunk: int) -> DataFrame:
    """Contexts with no more of their left bytes than some other context of their gram has; those that cannot match any more are dropped.

    The neighbours in the order of the left bytes tell; next to a boundary all bytes stay.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                suffix, left = part.column(0).to_pylist(), part.column(1).to_pylist()
                grams = [x[:GRAM] for x in suffix]
                group = np.cumsum([0, *(a != b for a, b in zip(grams, grams[1:], strict=False))])
                words = np.frombuffer(b"".join(x.ljust(REST, b"\0") for x in left), np.uint8).reshape(len(left), REST).view(">u8").astype(np.uint64)
                order, common = multikey_order(words, group)
                bound = np.maximum(common, np.append(common[1:], -1))
                bound[0] = bound[-1] = REST
                bound = bound[np.argsort(order, kind="stable")]
                left = [x[:b] for x, b in zip(left, np.maximum(bound, 0).tolist(), strict=True)]
                keep = pa.array([len(x) + len(y) >= SPAN for x, y in zip(left, suffix, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(left, pa.binary()), *part.columns[2:]], names=part.schema.names).filter(keep)

    gram = F.substring("suffix", 1, GRAM)
    return contexts.repartitionByRange(gram, "left", "suffix").sortWithinPartitions(gram, "left", "suffix").mapInArrow(run, contexts.schema)


def _resolved(contexts: DataFrame, chunk: int) -> DataFrame:
    """Range-partition contexts by their suffixes and sort them; resolve chunk by chunk, handing on what may cross a boundary.

    Rows with ``s`` are strings of the offset ``most`` that rows of another chunk may hold.
    """

    def work(rows: pa.Table, before: bool, beyond: bool) -> pa.RecordBatch:
        suffix, left = rows.column("suffix").to_pylist(), rows.column("left").to_pylist()
        grams = [x[:GRAM] for x in suffix]
        group = np.cumsum([0, *(a != b for a, b in zip(grams, grams[1:], strict=False))])
        h, c, n = (rows.column(x).to_numpy() for x in ("h", "c", "n"))
        most, least, far = resolve(group, left, [x[GRAM:] for x in suffix], n, before, beyond)
        pick = np.flatnonzero((most >= 0) & (n < 2))
        at = np.array([k for k, _, _ in far], np.int64)
        d = np.array([x for _, x, _ in far], np.int64)
        strings = [xxhash.xxh3_128_digest(bytes((x,)) + left[k][:x] + suffix[k][: SPAN - x]) for k, x, _ in far]
        columns = (
            np.concatenate([h[pick], h[at]]), np.concatenate([c[pick], c[at]]), np.concatenate([most[pick], d]).astype(np.int16), np.concatenate([least[pick], d]).astype(np.int16),
            [None] * len(pick) + strings, np.concatenate([np.zeros(len(pick), np.int32), np.array([x for _, _, x in far], np.int32)]),
        )
        kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["h", "c", "most", "least", "s", "n"])

    def run(batches):
        held: pa.Table | None = None
        before = True
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows <= chunk:
                continue
            held = held.combine_chunks()
            grams = [x[:GRAM] for x in held.column("suffix").to_pylist()]
            begin = 0
            while len(grams) - begin > chunk:
                cut = begin + chunk
                while cut > begin and grams[cut - 1] == grams[cut]:
                    cut -= 1
                cut = cut if cut > begin else begin + chunk  # between grams where one ends in the chunk
                beyond = grams[cut - 1] == grams[cut]
                yield work(held.slice(begin, cut - begin), before, beyond)
                begin, before = cut, beyond
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield work(held, before, True)

    return contexts.repartitionByRange("suffix", "left").sortWithinPartitions("suffix", "left").mapInArrow(run, RESOLVED)


def covered(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(doc, key, spans)``: per row that loses bytes, the ranges of bytes that go; they may overlap."""
    spark = docs.sparkSession
    rows = keyed(docs).drop("doc_id")
    grams = stored(_gram_counts(rows).groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 2").select("h", F.lit(True).alias("often")), "grams")
    release(spark)
    found = stored(_occurrences(rows).join(grams, "h", "left").filter("often or end >= 0").drop("often"), "anchors")
    release(spark)
    # The representative's columns are those of one row: a plain aggregate takes them from its first one together.
    one = [F.first(x).alias(x) for x in ("doc", "key", "at", "hi", "lo")]
    contexts = stored(found.filter("end < 0").groupBy("h", "c").agg(F.count("*").alias("n"), *one), "contexts")
    release(spark)
    groups = contexts.groupBy("h").agg(F.count("*").alias("k"), F.sum((F.col("n") < 2).cast("long")).alias("single")).filter("k >= 2 and single >= 1").select("h")
    groups = stored(groups, "groups")  # both sides of the next join are then plain exchanges, and a hot gram can be split
    mixed = contexts.join(groups, "h").groupBy("doc", "key").agg(F.collect_list(F.struct("at", "hi", "lo", "h", "c", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("asked"))

    def fetch(batches):
        from .common import sliced

        for batch in sliced(batches, 0):
            for text, asked in zip(texts(batch.column(0)), _lists(batch.column(1), 6), strict=True):
                for k in range(0, len(asked[0]) if asked else 0, 4096):
                    at, hi, lo, h, c, n = (x[k : k + 4096] for x in asked)
                    places = list(zip(at.tolist(), hi.tolist(), lo.tolist(), strict=True))
                    left = [text[a - d : a][::-1] for a, d, _ in places]
                    yield pa.RecordBatch.from_arrays([pa.array([text[a : a - e + SPAN] for a, _, e in places], pa.binary()), pa.array(left, pa.binary()), pa.array(h), pa.array(c), pa.array(n)], names=["suffix", "left", "h", "c", "n"])

    once = rows.join(mixed.hint("merge"), ["doc", "key"]).select("text", "asked")
    fetched = stored(once.mapInArrow(fetch, "suffix binary, left binary, h long, c long, n int"), "suffixes")
    release(spark)
    resolved = stored(_resolved(_left_bounded(fetched, chunk), chunk), "resolved")
    release(spark)
    across = resolved.filter("s is not null")
    often = across.groupBy("s").agg(F.sum("n").alias("total")).filter("total >= 2").select("s")
    crossed = across.filter("n < 2").join(often, "s", "left_semi").groupBy("h", "c").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    whole = contexts.filter("n >= 2").select("h", "c", F.col("hi").alias("most"), F.col("lo").alias("least"))
    ranges = stored(resolved.filter("s is null").select("h", "c", "most", "least").unionByName(crossed).unionByName(whole), "ranges")
    release(spark)
    at, end = F.col("at") - F.col("most").cast("int"), F.col("at") - F.col("least").cast("int") + SPAN
    gone = found.filter("end < 0").join(ranges, ["h", "c"]).select("doc", "key", at.alias("begin"), end.alias("end"))
    gone = gone.unionByName(found.filter("end >= 0").select("doc", "key", F.col("at").alias("begin"), "end"))
    return gone.groupBy("doc", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _lists(column: pa.ListArray, fields: int) -> list[tuple[np.ndarray, ...] | None]:
    """A list of structs per row as an array per field."""
    inner = column.values
    flat = [inner.field(k).to_numpy(zero_copy_only=False) for k in range(fields)]
    offsets = column.offsets.to_numpy()
    return [tuple(f[a:b] for f in flat) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def removed(spans: tuple[np.ndarray, ...] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that go."""
    if spans is None:
        return []
    order = np.argsort(spans[0], kind="stable")
    begin, end = spans[0][order].astype(np.int64), np.maximum.accumulate(spans[1][order].astype(np.int64))
    first = np.concatenate([[0], np.flatnonzero(begin[1:] > end[:-1]) + 1])
    return list(zip(begin[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist(), strict=True))


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in gone for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digest_report(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per row: bytes, bytes removed, removed runs, and the hash of what stays."""
    both = keyed(docs).join(covered(docs, chunk).hint("merge"), ["doc", "key"], "left").select("doc_id", "text", "spans")

    def each(batch):
        out: list[list] = [[], [], [], []]
        for text, spans in zip(texts(batch.column(1)), _lists(batch.column(2), 2), strict=True):
            gone = removed(spans)
            values = (len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(text, gone) if gone else text).hexdigest())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_texts(both, ["doc_id", "text", "spans"], each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs cut back to characters that lie wholly in them."""
    out = []
    for a, b in gone:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The documents, with all their columns, without the characters that lie wholly in repeated strings."""
    doc, key, held = (fresh(docs, x) for x in ("__doc", "__key", "__spans"))
    spans = covered(docs, chunk).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("spans").alias(held))
    own_doc, own_key = _identity()
    both = docs.join(spans.hint("merge"), (own_doc == F.col(doc)) & (own_key == F.col(key)), "left").select(*own_columns(docs), held)

    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            out = []
            for text, own in zip(texts(batch.column(at)), _lists(batch.column(n), 2), strict=True):
                if own:
                    text = _kept(text, _whole_characters(text, removed(own)))
                out.append(text.decode("utf-8", "replace"))
            yield with_texts(batch, at, out, n)

    return counted(map_whole(both, docs.columns, run), docs)
