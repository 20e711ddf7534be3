"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking (operator 1).

Fit, on a bounded sample (the ``SAMPLE`` vectors with the smallest hash of their id): coarse centroids
and, for the residuals to them, one codebook per subspace. Every vector is then assigned to its cell
and coded. The number of cells a query probes is not guessed: for ``TRIALS`` queries the true
neighbours are found by brute force over all rows, and the fewest probes that reach ``COVERAGE`` of
them all, and ``OWN_COVERAGE`` of its own for all but ``MISSED`` of the trial queries, hold for all queries. A
query whose cells hold few rows goes on to the next nearest cells until they hold ``SHORTLIST`` other rows
or no cell is left, so it gets ``k`` rows wherever there are as many.

Search: cells are laid out in groups of about ``GROUP`` rows, small cells together, a hot cell (say a
third of all rows) in as many groups as it needs. A query goes once to each group that holds a probed
cell, its own cell before all others, and where very many queries meet one group they are parted too. There its asymmetric tables (query against every codeword) rank the probed rows, the best
``SHORTLIST`` are rescored on the original vectors in double precision, and the ``k`` best leave the
group; the last step keeps the ``k`` best of all groups. The layout needs the rows per cell, which
are as many numbers as there are cells, at most ``MOST_CELLS``.

A shortlist of fixed length fails where the codes are coarse against what parts the neighbours: rows larger
than any in the sample, close copies in a table of scattered rows. So what coding lost of each row is known,
subspace by subspace, and each row whose estimate may be wrong by enough to reach the ``k`` th score of the
shortlist is rescored too, without a limit. Wrong by enough is the least of the largest possible error
and ``SPREAD`` standard deviations of the error if its direction is random.

Nearness is the inner product; ties go to the smaller id, also at the edge of a shortlist. What is fitted,
coded and estimated is in double precision and scaled by powers of two, the rows by one for all and each query by its own, so that
large and small vectors, also in one table, have squares within its range; scores are those of the original vectors.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another
length than most, take no part, nor do rows without an id; of the rows of one id, whether it is asked or found, the one
whose vector is least in the order of its bytes holds and the others take no part; with fewer than ``k``
candidates all are returned; a score beyond double precision is infinite, and an undefined one ranks last;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, MOST_CELLS, CODEWORDS, SUBSPACE = 32_768, 4096, 256, 4
TRIALS, COVERAGE, OWN_COVERAGE, MISSED = 128, 0.98, 0.9, 0.02
SHORTLIST, SPREAD, GROUP, QUERY_ROOM, QUERIES_AT_ONCE = 320, 4.0, 4096, 32_768, 128
RESULT = "query_id long, rank int, vec_id long, score double"


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of ``points``; fewer than ``k`` if there are fewer distinct points."""
    points = points.astype(np.float64)
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(points[order], (np.cumsum(count) - count)[full], axis=0)
        centres[full] = sums / count[full, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point, in blocks."""
    norms = (centres * centres).sum(1)
    return np.concatenate([(norms - 2 * points[i : i + 2048] @ centres.T).argmin(1) for i in range(0, len(points), 2048)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """What a fit leaves: small arrays that travel in the tasks' closures."""

    centres: np.ndarray  # cells x dim
    books: list[np.ndarray]  # per subspace: codewords x width
    cuts: list[int]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = nearest(vectors, self.centres)
        rest = vectors - self.centres[cells]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], 1)
        return cells, codes.astype(np.uint8)

    def lost(self, vectors: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Per row and subspace: how far the vector is from what its code stands for, rounding included."""
        out = []
        for a, b, book, code in zip(self.cuts, self.cuts[1:], self.books, codes.T, strict=False):
            x, c = vectors[:, a:b], self.centres[cells, a:b]
            out.append(np.linalg.norm(x - c - book[code], axis=1) + 1e-13 * (np.linalg.norm(x, axis=1) + np.linalg.norm(c, axis=1)))
        return np.stack(out, 1)

    def slack(self, queries: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """By how much an estimate may be too small, queries by rows."""
        weight = np.stack([np.linalg.norm(queries[:, a:b], axis=1) for a, b in zip(self.cuts, self.cuts[1:], strict=False)], 1)
        likely = SPREAD * np.sqrt((weight**2 / np.diff(self.cuts)) @ (lost**2).T)
        return np.minimum(weight @ lost.T, likely, out=likely)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per subspace: inner products of the queries with the codewords."""
        return [queries[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]


def train(sample: np.ndarray, total: int) -> Index:
    cells = int(min(MOST_CELLS, max(1, 2 ** round(np.log2(max(1.0, total**0.5))))))
    centres = kmeans(sample, cells)
    rest = sample - centres[nearest(sample, centres)]
    dim = sample.shape[1]
    cuts = [*range(0, dim, SUBSPACE), dim]
    books = [kmeans(rest[:8192, a:b], CODEWORDS) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Index(centres, books, cuts)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, whatever their length."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False)))


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _unpack(column: pa.ChunkedArray | pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Mask of the ``keep`` largest of each row, ties to the left."""
    if scores.shape[1] <= keep:
        return scores > -np.inf
    edge = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep, None]
    above, level = scores > edge, scores == edge
    room = keep - above.sum(1, keepdims=True)
    tied = np.flatnonzero(level.sum(1, keepdims=True) > room)
    level[tied] &= np.cumsum(level[tied], 1) <= room[tied]
    return (above | level) & (scores > -np.inf)


def _measure(exact: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products in double precision; an undefined one is below all others."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(exact @ data.T, nan=-np.finfo(float).max, posinf=np.inf, neginf=-np.finfo(float).max)


def _own_scale(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that its largest component is between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0, keepdims=True))[1])


def _order(queries: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Cells in the order in which each query probes them: its own, then by the inner product with the centre."""
    score = queries @ centres.T
    score[np.arange(len(queries)), own] = np.inf
    return np.argsort(-score, axis=1, kind="stable")


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_room: int = QUERY_ROOM) -> DataFrame:
    """The ``k`` nearest other rows of every row for which ``is_query`` (a condition on ``vec_id``) holds."""
    spark = vectors.sparkSession
    sound = usable(vectors, key, vector)
    largest = F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v).cast("double"))))
    sizes = sound.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("count"), largest.alias("largest")).orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    down = -int(np.frexp(sizes[0]["largest"])[1])  # the power of two that brings all components into one
    kind = "<f4" if dict(sound.dtypes)["vector"] == "array<float>" else "<f8"
    sound = sound.filter(F.size("vector") == dim)
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    index = train(np.ldexp(_matrix(sample.column(0).combine_chunks(), dim, np.float64), down), total)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim, kind)
                cells, codes = index.encode(np.ldexp(x.astype(np.float64), down))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "cell", "codes", "data"])

    rows = stored(sound.mapInArrow(encode, "vec_id long, cell int, codes binary, data binary"), "ivf")
    repeated = stored(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated")
    if not repeated.isEmpty():
        one = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("data", "cell", "codes")).alias("row"))
        one = one.select("vec_id", "row.cell", "row.codes", "row.data")
        rows = stored(rows.join(repeated, "vec_id", "left_anti").unionByName(one), "ivf")
    asked = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "data", "cell")
    probes = _probes(rows, asked, index, k, kind, dim)

    held = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most one row per cell
    filled = np.array([held.get(c, 0) for c in range(len(index.centres))], np.int64)
    first, parts = np.zeros(len(index.centres), np.int64), np.ones(len(index.centres), np.int64)
    group = room = 0
    for cell in range(len(index.centres)):
        n = held.get(cell, 0)
        if n > GROUP:
            group += room > 0
            first[cell], parts[cell] = group, -(-n // GROUP)
            group, room = group + parts[cell], 0
            continue
        if room + n > GROUP:
            group, room = group + 1, 0
        first[cell] = group
        room += n

    def deal_rows(batches):
        for batch in batches:
            cells = batch.column(1).to_numpy()
            ids = batch.column(0).to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                spread = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([pa.array(first[cells] + spread.astype(np.int64) % parts[cells]), *batch.columns], names=["grp", *batch.schema.names])

    def deal_queries(batches):
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            near = _order(_own_scale(_unpack(batch.column(1), kind, dim).astype(np.float64)), index.centres, batch.column(2).to_numpy())
            # Cells up to the one with which SHORTLIST rows and the query's own are met.
            most = np.maximum(probes, 1 + (np.cumsum(filled[near], axis=1) <= SHORTLIST).sum(1))
            take = [cells[:n] for cells, n in zip(near, most, strict=True)]
            out: list[list] = [[], [], [], []]
            for query, data, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), take, strict=True):
                to: dict[int, list[int]] = {}
                for c in cells[filled[cells] > 0].tolist():
                    for g in range(first[c], first[c] + parts[c]):
                        to.setdefault(int(g), []).append(c)
                for g, cs in to.items():
                    for column, value in zip(out, (g, query, data, cs), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int32()))], names=["grp", "query_id", "data", "cells"])

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("vec_id")
            ids = rows.column("vec_id").to_numpy()
            here = set(rows.column("cell").to_pylist())
            own = np.array(sorted(here))
            cell = np.searchsorted(own, rows.column("cell").to_numpy())
            codes = _unpack(rows.column("codes"), np.uint8, len(index.books))
            data = _unpack(rows.column("data"), kind, dim).astype(np.float64)
            scaled = np.ldexp(data, down)
            lost = index.lost(scaled, rows.column("cell").to_numpy(), codes)
            rounding = 1e-12 * np.linalg.norm(scaled, axis=1)
            keep = max(SHORTLIST, k)
            for at in range(0, queries.num_rows, QUERIES_AT_ONCE):
                part = queries.slice(at, QUERIES_AT_ONCE)
                exact = _unpack(part.column("data"), kind, dim).astype(np.float64)
                q = _own_scale(exact)
                query_ids = part.column("query_id").to_numpy()
                probed = np.zeros((len(q), len(own)), bool)
                for i, cells in enumerate(part.column("cells").to_pylist()):
                    probed[i, np.searchsorted(own, [c for c in cells if c in here])] = True
                score = (index.centres[own] @ q.T)[cell]
                for table, code in zip(index.tables(q), codes.T, strict=True):
                    score += np.ascontiguousarray(table.T)[code]
                score = np.ascontiguousarray(score.T)
                score[~probed[:, cell] | (ids[None, :] == query_ids[:, None])] = -np.inf
                short = _best(score, keep)
                if len(ids) > keep:
                    score += index.slack(q, lost)
                for i in range(len(q)):
                    pick = np.flatnonzero(short[i])
                    if len(pick) == keep < len(ids):
                        edge = np.partition(scaled[pick] @ q[i], keep - k)[keep - k]
                        pick = np.flatnonzero(short[i] | (score[i] >= edge))
                    if kind == "<f4" and len(pick) > k:  # products of doubles may overflow or vanish and tie
                        near = scaled[pick] @ q[i]
                        pick = pick[near + rounding[pick].max() * np.linalg.norm(q[i]) >= np.partition(near, len(pick) - k)[len(pick) - k]]
                    with np.errstate(over="ignore", invalid="ignore"):
                        value = np.nan_to_num((data[pick] * exact[i]).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    order = np.lexsort((ids[pick], -value))[:k]
                    found[0] += [query_ids[i]] * len(order)
                    found[1] += ids[pick[order]].tolist()
                    found[2] += value[order].tolist()
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    left = rows.mapInArrow(deal_rows, "grp long, vec_id long, cell int, codes binary, data binary")
    right = asked.mapInArrow(deal_queries, "grp long, query_id long, data binary, cells array<int>")
    if asked.count() > query_room:
        # Where more queries meet a group than a task should hold, they are parted, and its rows are repeated for each part.
        right = stored(right, "asked")
        parts_of = stored(right.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(query_room)).cast("int").alias("most")), "parts")
        right = right.join(parts_of, "grp").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("most")).cast("int")).drop("most")
        left = left.join(parts_of, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).drop("most")
    else:
        left, right = left.withColumn("part", F.lit(0)), right.withColumn("part", F.lit(0))
    near = left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _probes(rows: DataFrame, asked: DataFrame, index: Index, k: int, kind: str, dim: int) -> int:
    """The fewest cells that hold ``COVERAGE`` of the true neighbours of the trial queries, and ``OWN_COVERAGE`` of each but a few."""
    trial = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIALS).toArrow()
    if not trial.num_rows:
        return 1
    ids, exact = trial.column("query_id").to_numpy(), _unpack(trial.column("data"), kind, dim).astype(np.float64)

    def scan(batches):
        """The best of each partition for every trial query."""
        best: list[tuple[np.ndarray, ...]] = []

        def cut(parts):
            q, v, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, c, s = q[order], v[order], c[order], s[order]
            start = np.searchsorted(q, np.arange(len(ids)))
            keep = np.arange(len(q)) - start[q] < k
            return q[keep], v[keep], c[keep], s[keep]

        for batch in batches:
            v, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data = _unpack(batch.column(2), kind, dim).astype(np.float64)
            for a in range(0, len(v), 4096):
                score = _measure(exact, data[a : a + 4096])
                score[ids[:, None] == v[None, a : a + 4096]] = -np.inf
                q, at = np.nonzero(_best(score, k))
                best = [cut([*best, (q, v[a + at], c[a + at].astype(np.int64), score[q, at])])]
        for q, v, c, s in best:
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(v), pa.array(c.astype(np.int32)), pa.array(s)], names=["q", "vec_id", "cell", "score"])

    near = rows.select("vec_id", "cell", "data").mapInArrow(scan, "q int, vec_id long, cell int, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "cell").collect()  # at most TRIALS x k rows
    if not true:
        return 1
    order = _order(_own_scale(exact), index.centres, trial.column("cell").to_numpy())
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(order), 0), 1)
    query, ranks = np.array([r["q"] for r in true]), np.array([place[r["q"], r["cell"]] for r in true])

    def share(values: np.ndarray, part: float) -> int:
        return int(np.sort(values)[max(0, int(np.ceil(part * len(values))) - 1)])

    each = np.array([share(ranks[query == q], OWN_COVERAGE) for q in np.unique(query)])
    return max(share(ranks, COVERAGE), share(each, 1 - MISSED)) + 1
