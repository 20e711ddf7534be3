"""N-gram Jaccard join by MinHash banding (operator 10).

A document is the set of its word 5-grams (64-bit hashes; a shorter text is one gram of all its
words). Documents with equal sets are one class. Bands and rows are chosen for the target recall at
the threshold; classes are dealt by their band hashes, and every bucket ties its members to its
smallest one, so a bucket of m members makes m rows, not m * m. The components of these ties are the
candidate groups; in each of them all pairs are verified on the full sets, blocks of members against
blocks, inside tasks. What leaves a task is, per member, the number of its links and one edge of a
spanning forest, never the pairs.

Result: one row per document with ``class_id`` (smallest id of all documents that links connect),
``text_class`` (smallest id with an equal set) and ``n_links`` (documents with a similarity of at
least the threshold, copies included).

Scale: counts are aggregated before they are shuffled, a candidate group of more than ``BLOCK`` members
or ``BLOCK_GRAMS`` n-grams is spread over its pairs of blocks, small groups share tasks, and components are found by alternating
star contractions over edge tables. The sets themselves travel once, for candidates only.

Defined cases: null and empty texts have the empty set, and are copies of each other but similar to
nothing else; rows without an id are returned with null class and links and take no part; rows of one
id are one document, whose texts are joined into one class; an empty table gives an empty result;
other columns are ignored by ``join``, carried by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts, release, stored, texts

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
#: Members of a block and of a room of small groups; n-grams that these may hold together; words that a worker remembers.
BLOCK, TOGETHER, BLOCK_GRAMS, MOST_CACHED = 512, 2000, 2_000_000, 400_000
RESULT = "doc_id long, class_id long, n_links long, text_class long"


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most rows per band whose bands reach the recall at the threshold within ``most`` hashes; raises where none do."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("the threshold must be in (0, 1] and the recall between 0 and 1")
    if threshold == 1:
        return 1, 1
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"a recall of {recall} at a similarity of {threshold} takes {bands} hashes, more than {most}")
    return best


class Shingler:
    """Distinct n-gram hashes of texts; remembers the hashes of words."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def grams(self, text: bytes) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > MOST_CACHED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * self.FACTOR
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """``(doc_id, s1, s2, n, bands)``: a 128-bit name of each set, its size, and its band hashes."""
    # Odd factors permute 32-bit numbers; the grams are hashes already, so a product orders them at random.
    seeds = np.random.default_rng(97).integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)

    def make():
        shingler = Shingler(words)

        def each(batch):
            names, sizes, sign = [], [], np.zeros((batch.num_rows, bands), np.int64)
            for i, text in enumerate(texts(batch.column(1))):
                grams = shingler.grams(text)
                names.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sizes.append(len(grams))
                heads = (grams >> np.uint64(32)).astype(np.uint32)
                least = np.full(bands * rows, ~np.uint32(0))
                for at in range(0, len(heads), 4096):
                    least = np.minimum(least, np.multiply.outer(seeds, heads[at : at + 4096]).min(1))
                mix = np.zeros(bands, np.uint64)
                for column in least.reshape(bands, rows).T.astype(np.uint64):
                    mix = (mix ^ column) * Shingler.FACTOR
                    mix ^= mix >> np.uint64(31)
                sign[i] = mix.view(np.int64)
            pair = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            offsets = pa.array(np.arange(0, len(names) * bands + 1, bands, dtype=np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sign.ravel()))], names=["doc_id", "s1", "s2", "n", "bands"])

        return each

    held: list = []

    def each(batch):
        if not held:
            held.append(make())
        return held[0](batch)

    return map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], each, "doc_id long, s1 long, s2 long, n long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of an edge table ``(a, b)``: every node that has an edge, with the least one of its component.

    Large and small stars by turns until the edges no longer change.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that both sides of the join are plain exchanges and a node with very many edges can be split.
        held = least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")
        tied = large.join(least, F.col("a") == F.col("u"))
        edges = stored(tied.select("a", F.col("m").alias("b")).union(tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return held.select(F.col("u").alias("node"), F.col("m").alias("comp"))  # the edges were stars already
        mark = now


def _links(sets: list[np.ndarray], ids: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per member: documents linked to it here, and the least member that its links connect it to."""
    n = len(sets)
    count = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), count)
    _, name, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    column = place[name]
    some = column >= 0
    column, owner = column[some], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    meet = np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((n, min(4096, len(shared) - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        meet += part @ part.T
    meet = np.rint(meet).astype(np.int64)
    near = meet >= threshold * (count[:, None] + count[None, :] - meet) - 1e-9
    near &= meet > 0
    np.fill_diagonal(near, False)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    root = ids.copy()
    while True:
        new = root.copy()
        for i in np.flatnonzero(near.any(1)):
            new[i] = min(new[i], new[near[i]].min())
        if (new == root).all():
            break
        root = new
    return near.astype(np.int64) @ sizes, root


def verified(members: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """``(rep, links, root)`` rows of all pairs within each candidate group; ``members``: (rep, size, n, comp)."""
    total, grams = members.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], "rep long, links long, root long")
    blocks = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rooms = max(1, -(-total // TOGETHER), -(-grams // BLOCK_GRAMS))
    room = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(rooms))).otherwise(F.col("comp"))
    dealt = dealt.select("rep", "size", "comp", "blocks", own.alias("side"), room.alias("room"))

    def read(batches):
        from .common import sliced

        shingler = Shingler(words)
        for batch in sliced(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([shingler.grams(t).tobytes() for t in texts(batch.column(0))], pa.binary()), *batch.columns[1:]], names=["grams", *batch.schema.names[1:]])

    own_docs = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    # A merge join at every size: what is moved follows the input, and no side is broadcast by chance.
    held = own_docs.join(dealt.hint("merge"), "rep").select("text", "rep", "size", "comp", "blocks", "side", "room").mapInArrow(read, "grams binary, rep long, size long, comp long, blocks int, side int, room long")
    # A member of block s meets every block, its own included: keys (least, largest) of the two.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = held.select("grams", "rep", "size", "comp", "side", "blocks", "room", other)
    spread = spread.select("grams", "rep", "size", "comp", "side", "room", F.when(F.col("blocks") > 1, F.least("side", "other") + 1).otherwise(0).alias("i"), F.when(F.col("blocks") > 1, F.greatest("side", "other") + 1).otherwise(0).alias("j"))

    def check(rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        comp = rows.column("comp").to_numpy()
        order = np.argsort(comp, kind="stable")
        reps, sizes, sides = (rows.column(x).to_numpy() for x in ("rep", "size", "side"))
        grams = rows.column("grams")
        across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            sets = [np.frombuffer(grams[int(k)].as_py(), np.uint64) for k in at]
            links, root = _links(sets, reps[at], sizes[at], sides[at] if across else None, threshold)
            some = links > 0
            out[0].append(reps[at][some])
            out[1].append(links[some])
            out[2].append(root[some])
        return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in zip(("rep", "links", "root"), out, strict=True)})

    return spread.groupBy("room", "i", "j").applyInArrow(check, "rep long, links long, root long")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """Class, links and equal-set class of every document."""
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall)
    signs = stored(signatures(docs, bands, rows, words), "signatures")
    classes = stored(signs.filter("doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    release(spark)
    dealt = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = dealt.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub <> top").select("band", "hash", "hub")
    ties = dealt.join(buckets, ["band", "hash"]).filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    groups = components(ties)
    release(spark)
    sizes = classes.groupBy("rep").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    members = stored(groups.join(sizes, groups["node"] == sizes["rep"]).select("rep", "size", "n", "comp"), "members")
    found = stored(verified(members, docs, threshold, words, block), "links")
    release(spark)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("s1", "s2", "rep", "size").join(links, "rep", "left").join(tied, F.col("rep") == F.col("node"), "left")
    known = known.select("s1", "s2", F.col("rep").alias("text_class"), F.coalesce("comp", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    every = signs.select("doc_id", "s1", "s2").join(known, ["s1", "s2"], "left")
    idle = F.col("doc_id").isNotNull()
    return every.select("doc_id", F.when(idle, F.col("class_id")).alias("class_id"), F.when(idle, F.col("n_links")).alias("n_links"), F.when(idle, F.col("text_class")).alias("text_class"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, but only the smallest id of each class; rows without an id stay.

    Rows that share an id but not their text are documents of their own, in the order of their texts' hashes, so that no
    text is lost that is similar to no other. Of rows that share both, the one whose columns have the least hash stays.
    """
    ident = F.col("doc_id").cast("long")
    name, key, mark, other, row = (fresh(docs, x) for x in ("__gone", "__key", "__mark", "__other", "__row"))
    if not docs.filter(ident.isNotNull()).groupBy(ident.alias(name)).count().filter("count > 1").limit(1).count():
        gone = join(docs, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
        return docs.join(gone.hint("merge"), ident == F.col(name), "left_anti")
    marked = docs.withColumn(mark, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # Numbers in the order of a sorted table stand for the ids, so that the least number has the smallest id.
    keys = marked.filter(ident.isNotNull()).select(ident.alias(name), F.col(mark).alias(other)).distinct().orderBy(name, other)
    keys = stored(keys.withColumn(key, F.monotonically_increasing_id()), "keys")
    keyed = stored(marked.join(keys.hint("merge"), (ident == F.col(name)) & (F.col(mark) == F.col(other)), "left").drop(name, mark, other), "keyed")
    gone = join(keyed.select(F.col(key).alias("doc_id"), "text"), threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    left = keyed.join(gone.hint("merge"), F.col(key) == F.col(name), "left_anti")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    least = F.xxhash64(*(c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()))
    one = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), least).alias(row)).select(f"{row}.*")
    return left.filter(F.col(key).isNull()).select(*columns).unionByName(one)
