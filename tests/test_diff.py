import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import canon, globs
from tidemark.operators import diff as D
from tidemark.operators import merge as M
from tidemark.plans.config import ConflictPolicy, DuplicateKey

ITEMS = "id long, name string, updated_at string"


def buckets(df):
    return {r["pk"]: r["bucket"] for r in df.select("pk", "bucket").collect()}


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*_embedding", ["title_embedding", "_embedding"], ["embedding", "embedding_x"]),
        ("embedding_*", ["embedding_v2"], ["x_embedding_"]),
        ("vector", ["vector"], ["vectors", "Vector"]),
        ("*embed*", ["embed", "an_embedding"], ["emb"]),
        ("*", ["anything", ""], []),
        ("**", ["anything"], []),
        ("a*b", ["a*b"], ["axb", "ab"]),
    ],
)
def test_globs(pattern, yes, no):
    assert all(globs.matches(pattern, x) for x in yes)
    assert not any(globs.matches(pattern, x) for x in no)


def test_user_tables_hide_by_literal_beginnings():
    assert globs.user_tables(["users", "sqlite_stat1", "sqliteX1", "_cf_KV", "acfbx"]) == ["acfbx", "sqliteX1", "users"]


def test_classify_buckets(spark):
    local = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", "2024-01-01"), (4, "d", "2024-01-01"), (5, "e", None), (6, "f", "2024-01-01"), (8, None, "1")], ITEMS)
    remote = spark.createDataFrame([(2, "x", "2024-01-01"), (3, "x", "2024-01-02"), (4, "x", "2024-01-01"), (5, "x", "2024-01-01"), (6, "f", "2030-01-01"), (7, "g", "2024-01-01"), (8, "", "1")], ITEMS)
    found = D.diff_table(local, remote, ["id"], "updated_at")
    want = {"1": D.LOCAL_ONLY, "2": D.LOCAL_NEWER, "3": D.REMOTE_NEWER, "4": D.CONTENT_DIFFERS, "5": D.CONTENT_DIFFERS, "6": D.IDENTICAL, "7": D.REMOTE_ONLY, "8": D.IDENTICAL}
    assert buckets(found) == want
    assert D.stats(found).first().asDict() == {"local_only": 1, "remote_only": 1, "local_newer": 1, "remote_newer": 1, "content_differs": 2, "identical": 2}
    assert D.has_changes(found).first()[0]
    assert D.summary(found).first()[0] == "+1 local only, +1 remote only, 1 local newer, 1 remote newer, 2 conflicts, 2 identical"
    assert {r["bucket"]: r["pks"] for r in D.detail(found).collect()}["content_differs"] == ["4", "5"]
    assert D.rows_to_delete(found).count() == 0


def test_empty_sides(spark):
    none = spark.createDataFrame([], ITEMS)
    found = D.diff_table(none, none, ["id"], "updated_at")
    assert not D.has_changes(found).first()[0]
    assert D.summary(found).first()[0] == "no data"


def test_text_timestamps_compare_as_text_and_numbers_as_numbers(spark):
    def pair(a, b, kind):
        l, r = (spark.createDataFrame([(1, n, t)], f"id long, name string, updated_at {kind}") for n, t in (("a", a), ("b", b)))
        return D.diff_table(l, r, ["id"], "updated_at").first()["bucket"]

    assert pair("9", "10", "string") == D.LOCAL_NEWER
    assert pair(9, 10, "long") == D.REMOTE_NEWER


def test_hash_is_sha256_of_texts_with_separators(spark):
    df = spark.createDataFrame([(1, "x|y", 1.0, 10000000.5, True, bytearray(b"\xde\xad"), None, "2024")], "id long, s string, d double, e double, b boolean, raw binary, n string, updated_at string")
    got = canon.with_meta(df, ["id"], "updated_at").first()["content_hash"]
    assert got == hashlib.sha256(b"1|x|y|1|10000000.5|1|dead||").hexdigest()
    loose, framed = (df.select(canon.content_hash(df.schema, ["s", "n"], **k)).first()[0] for k in ({}, {"framed": True, "null_token": "\0"}))
    assert loose != framed


@pytest.mark.parametrize("value, text", [(1.0, "1"), (0.1, "0.1"), (1e7, "10000000"), (123.25, "123.25"), (-5.5, "-5.5"), (0.0, "0"), (1e21, "1.0E21"), (1e-20, "1.0E-20"), (float("nan"), "NaN"), (float("inf"), "Infinity")])
def test_double_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "d double")
    assert df.select(canon.text_of("d", df.schema["d"].dataType)).first()[0] == text


def test_all_columns_excluded_hashes_the_empty_text(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert canon.with_meta(df, ["id"], None, ["*"]).first()["content_hash"] == hashlib.sha256(b"").hexdigest()


def test_composite_key_text_follows_the_columns(spark):
    df = spark.createDataFrame([("x", 2, 3)], "b string, a long, v long")
    assert canon.with_meta(df, ["a", "b"]).first()["pk"] == "x|2"


def test_ambiguous_composite_keys_stay_apart(spark):
    df = spark.createDataFrame([("a|", "b", 1), ("a", "|b", 2)], "x string, y string, v long")
    found = D.diff_table(df, df.withColumn("v", F.col("v") + F.when(F.col("x") == "a", 1).otherwise(0)), ["x", "y"])
    assert sorted(r["bucket"] for r in found.collect()) == [D.CONTENT_DIFFERS, D.IDENTICAL]


def test_bad_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, v string")
    assert {(r["id"], r["n"]) for r in D.bad_keys(df, ["id"]).collect()} == {(1, 2), (None, 1)}
    with pytest.raises(DuplicateKey):
        D.require_keys(df, ["id"])
    D.require_keys(df.filter("id = 2"), ["id"])


def test_uuidv7(spark):
    rows = [("018ec7e6-1a80-7000-8000-000000000000",), ("018EC7E61A8070008000000000000000",), ("550e8400-e29b-41d4-a716-446655440000",), ("short",), (None,)]
    df = spark.createDataFrame(rows, "u string")
    assert [r[0] for r in df.select(canon.uuidv7_ms(F.col("u"))).collect()] == [0x018EC7E61A80, 0x018EC7E61A80, None, None, None]


@pytest.mark.parametrize(
    "policy, push, pull",
    [
        ("local_wins", {"local_only", "local_newer", "content_differs"}, {"remote_only", "remote_newer"}),
        ("remote_wins", {"local_only", "local_newer"}, {"remote_only", "remote_newer", "content_differs"}),
        ("newer_wins", {"local_only", "local_newer"}, {"remote_only", "remote_newer"}),
        ("uuid_v7_wins", {"local_only", "local_newer"}, {"remote_only", "remote_newer"}),
    ],
)
def test_policies(policy, push, pull):
    p = ConflictPolicy.parse(policy)
    assert set(D.push_buckets(p)) == push and set(D.pull_buckets(p)) == pull


def test_upsert_modes(spark):
    target = spark.createDataFrame([Row(id=1, a="x", b="keep"), Row(id=2, a="y", b="keep")])
    incoming = spark.createDataFrame([Row(id=2, a="new", other=1), Row(id=3, a="z", other=2)])
    rows = lambda mode: {tuple(r) for r in M.upsert(target, incoming, ["id"], mode).collect()}
    assert rows("preserve") == {(1, "x", "keep"), (2, "new", "keep"), (3, "z", None)}
    assert rows("replace") == {(1, "x", "keep"), (2, "new", None), (3, "z", None)}
    assert M.upsert(target, incoming, ["id"]).columns == target.columns


SIDE = st.dictionaries(st.integers(0, 8), st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["1", "2", None])), max_size=8)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SIDE, SIDE)
def test_invariants(spark, a, b):
    l, r = (spark.createDataFrame([(k, *v) for k, v in x.items()], ITEMS) for x in (a, b))
    found, back = (buckets(D.diff_table(x, y, ["id"], "updated_at")) for x, y in ((l, r), (r, l)))
    assert set(found) == {str(k) for k in a.keys() | b.keys()}
    swap = {D.LOCAL_ONLY: D.REMOTE_ONLY, D.REMOTE_ONLY: D.LOCAL_ONLY, D.LOCAL_NEWER: D.REMOTE_NEWER, D.REMOTE_NEWER: D.LOCAL_NEWER}
    assert {k: swap.get(v, v) for k, v in found.items()} == back
    assert set(buckets(D.diff_table(l, l, ["id"], "updated_at")).values()) <= {D.IDENTICAL}
