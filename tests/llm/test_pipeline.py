"""The pipeline stage by stage, against brute force on its own inputs."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_lines, brute_links, brute_spans, docs, line_texts, messy, near_texts, repeated_texts  # noqa: F401

from tidemark.llm import quality_rules, queries


def test_stages_keep_columns_and_take_effect(spark, messy):  # noqa: F811
    held = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, "")
        assert after.columns == messy.columns, name
        held = after.cache()
        held.count()
    assert corpus_pipeline.STAGES[-1][1](spark, held, "").columns[-2:] == ["sequence_id", "offset"]
    empty = messy.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_stages_against_brute_force(spark):
    good = "The story goes on and on, and it is told by many people in all of the towns of this land, says number "
    texts = [good + f"{i}.\n" + t for i, t in enumerate([*line_texts()[:20], *near_texts(40), *repeated_texts(30)])]
    d = docs(spark, texts)
    stages = dict(corpus_pipeline.STAGES)

    kept = {r["doc_id"]: r["text"] for r in stages["quality rules"](spark, d, "").collect()}
    for i, t in enumerate(texts):
        _, _, keep, fails = quality_rules.judged(t.encode())
        want = "\n".join(x for x, f in zip(t.split("\n"), fails, strict=True) if not f)
        assert kept.get(i) == (want if keep else None)

    pairs = list(enumerate(texts))
    got = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in stages["line dedup"](spark, d, "").collect()}
    assert got == {i: sha for i, _, _, sha in brute_lines(pairs)}

    classes = brute_links(texts, list(range(len(texts))))
    assert {r["doc_id"] for r in stages["n-gram jaccard join"](spark, d, "").collect()} == {c for c, _ in classes.values()}

    left = {r["doc_id"]: len(r["text"].encode()) for r in stages["suffix-array dedup"](spark, d, "").collect()}
    for (i, t), (n, gone, runs, _) in zip(pairs, brute_spans([t.encode() for t in texts]), strict=True):
        assert n - gone <= left[i] <= n - gone + 6 * runs, (i, t)  # a cut character stays whole


def test_run_and_registration(spark, sf_small):
    rows = corpus_pipeline.run(spark, sf_small).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def brute_run(rows):
    """``(doc_id, text)`` rows that reach the last stage, by plain means."""
    held = []
    for i, t in rows:
        _, _, keep, fails = quality_rules.judged((t or "").encode())
        if keep:
            held.append((i, "\n".join(x for x, f in zip(t.split("\n"), fails, strict=True) if not f)))
    lines = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in held:
        for x in t.split("\n"):
            if len(key(x)) >= 20 and i is not None:
                lines[key(x)].add(i)
    held = [(i, "\n".join(x for x in t.split("\n") if i is None or len(lines[key(x)]) < 3 or i == max(lines[key(x)]))) for i, t in held]
    known = sorted({x for x in held if x[0] is not None})
    classes = brute_links([t for _, t in known], list(range(len(known))))
    held = [known[k] for k, (c, _) in classes.items() if c == k] + [x for x in held if x[0] is None]
    data = [t.encode() for _, t in held]
    seen = collections.Counter(t[k : k + 200] for t in data for k in range(len(t) - 199))
    out = []
    for (i, text), t in zip(held, data, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        at, left = 0, []
        for c in text:
            n = len(c.encode())
            if not gone[at : at + n].all():
                left.append(c)
            at += n
        out.append((i, "".join(left)))
    return out


def test_run_of_messy_documents(spark, tmp_path):
    """Nulls in any column, ties, repeated rows, a very long text and clashing columns, from the table to the windows."""
    from tidemark.llm.packing import encoder

    rng = random.Random(11)
    good = "The story goes on and on, and it is told by many people in all of the towns of this land, says number "
    texts = [good + f"{i}.\n" + t for i, t in enumerate([*line_texts()[:15], *near_texts(30), *repeated_texts(25)])]
    texts.append("\n".join(" ".join(f"{rng.choice('aéß')}{rng.randrange(10**6)}" for _ in range(12)) + "." for _ in range(1200)))
    rows = [*enumerate(texts), *list(enumerate(texts))[3:6], (2, texts[40]), (None, good + "none, and nothing else is to be said of it."), (900, None), (901, ""), (902, "\n\n"), (903, "x " * 5000)]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    for c in ("block", "rank", "digest", "size", "h", "c", "doc", "at", "rep", "bands", "__id", "__drops", "__spans", "__gone", "a.b"):
        df = df.withColumn(c, F.lit(None).cast("int") if c == "h" else F.lit(c))
    for c in ("lang", "source", "n_chars"):
        df = df.withColumn(c, F.when(F.col("doc_id") % 3 > 0, F.col(c)))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = collections.Counter()
    for i, t in brute_run(rows):
        ids = [*encoder().encode(t, allowed_special="all"), 1]
        for a in range(0, len(ids), 2048):
            part = np.array(ids[a : a + 2048], "<u4")
            want[i, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 2048
