import json
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from tidemark import cli
from tidemark.operators import batching, cache, peer
from tidemark.operators import diff as D
from tidemark.operators import sync as S
from tidemark.plans import config as C
from tidemark.plans.config import SyncConfig
from tidemark.sources import relay as R
from tidemark.sources.files import Files
from tidemark.sources.store import MemoryStore, ParquetStore, TableSpec

ITEMS = "id long, name string, updated_at string"


def store(spark, rows, schema=ITEMS, name="items", pk=("id",)):
    return MemoryStore({name: spark.createDataFrame(rows, schema)}, {name: TableSpec(name, list(pk))})


def rows(s, name="items"):
    return {tuple(r) for r in s.table(name).collect()}


def parquet(spark, root, rows, schema=ITEMS, name="items"):
    s = ParquetStore(spark, str(root), create=True)
    s.add(TableSpec(name, ["id"], "updated_at"), spark.createDataFrame(rows, schema))
    return s


A = [(1, "mine", "2024-01-02"), (2, "same", "2024-01-01"), (3, "mine", "2024-01-01"), (4, "only", "2024-01-01")]
B = [(1, "theirs", "2024-01-01"), (2, "same", "2024-01-01"), (3, "theirs", "2024-01-01"), (5, "only", "2024-01-01")]


@pytest.mark.parametrize("policy, differ", [("local_wins", 0), ("remote_wins", 0), ("newer_wins", 1)])
def test_sync_converges(spark, policy, differ):
    a, b = store(spark, A), store(spark, B)
    config = SyncConfig(conflict_resolution=C.ConflictPolicy.parse(policy))
    S.sync_all(a, b, config)
    counts = D.stats(S.diff_of(a, b, "items", config)).first().asDict()
    assert counts["content_differs"] == differ and counts["identical"] == 5 - differ and sum(counts.values()) == 5
    assert not any(r.has_changes for r in S.sync_all(a, b, config))


def test_fingerprints_pass_over_equal_tables(spark, monkeypatch):
    config = SyncConfig(fingerprint_first=True)
    a, b = store(spark, A), store(spark, A[::-1])
    assert S.alike(a, b, "items", config) and not S.alike(a, store(spark, B), "items", config)
    monkeypatch.setattr(S, "diff_of", None)
    assert S.sync_all(a, b, config) == [S.SyncResult("items")]


def test_push_and_pull_touch_one_side(spark):
    a, b = store(spark, A), store(spark, B)
    assert S.push_all(a, b, SyncConfig())[0] == S.SyncResult("items", 3, 0)
    assert rows(a) == set(A) and (5, "only", "2024-01-01") in rows(b)
    a, b = store(spark, A), store(spark, B)
    assert S.pull_all(a, b, SyncConfig())[0] == S.SyncResult("items", 0, 1)
    assert rows(b) == set(B)


def test_dry_run_changes_nothing(spark):
    a, b = store(spark, A), store(spark, B)
    out = S.sync_all(a, b, SyncConfig(), dry_run=True, verbose=True)
    report = S.dry_run_output("sync", out)
    assert rows(a) == set(A) and rows(b) == set(B)
    assert report["tables"][0]["local_only"] == ["4"] and report["total_rows_to_push"] == 3 and report["status"] == "dry_run"
    assert S.dry_run_output("sync", S.sync_all(a, b, SyncConfig(), dry_run=True))["tables"][0]["local_only"] == 1


def test_excluded_columns_do_not_differ_and_are_preserved(spark):
    schema = "id string, content string, content_embedding binary, updated_at string"
    a = store(spark, [("1", "same", bytearray(b"\xde"), "1"), ("2", "new", bytearray(b"\x01"), "2")], schema)
    b = store(spark, [("1", "same", bytearray(b"\xca"), "1"), ("2", "old", bytearray(b"\x02"), "1")], schema)
    S.push_all(a, b, SyncConfig(exclude_columns=["*_embedding"]))
    assert {(r["id"], r["content"], bytes(r["content_embedding"])) for r in b.table("items").collect()} == {("1", "same", b"\xca"), ("2", "new", b"\x02")}


def test_table_choice(spark, caplog):
    frames = dict.fromkeys(("users", "posts", "sqlite_sequence", "nokey"))
    a = MemoryStore(frames, {n: TableSpec(n, ["id"]) for n in ("users", "posts")})
    b = MemoryStore({**frames, "extra": None}, {})
    assert S.tables_to_sync(a, b, SyncConfig()) == ["posts", "users"]
    assert S.tables_to_sync(a, b, SyncConfig(tables=["users"], exclude_tables=["users"])) == []
    for bad in ("Users", "users; DROP TABLE users", "", "nope"):
        with pytest.raises(C.NotFound, match="posts"):
            S.validated(bad, a.list_tables())


def test_engine_events(spark):
    seen = []
    e = S.Engine(store(spark, A), store(spark, B))
    off = e.on("table-changed", seen.append)
    e.push()
    assert seen == []
    e.pull()
    assert [(x["table"], x["changedPks"], x["removedPks"], x["source"]) for x in seen] == [("items", ["5"], [], "pull")]
    off()
    assert e.diff()["items"]["identical"] == 5
    assert e.erase_local() == ["items"] and rows(e.local) == set() and e.local.table("items").columns == ["id", "name", "updated_at"]
    e.update_target(None)
    assert e.diff()["items"]["local_only"] == 0
    with pytest.raises(C.NotFound):
        e.push()


@pytest.mark.parametrize("most", [1000, 7])
def test_engine_events_name_all_keys(spark, most):
    from pyspark.sql import functions as F

    n, seen, failed = 2503, [], []
    many = MemoryStore({"items": spark.range(n).select("id", F.lit("new").alias("name"), F.lit("2024-01-01").alias("updated_at"))}, {"items": TableSpec("items", ["id"])})
    e = S.Engine(store(spark, []), many, most_keys=most)

    def fail(event):
        failed.append(event)
        raise ValueError

    e.on("table-changed", fail)
    e.on("table-changed", seen.append)
    assert e.pull()[0].pulled == n and e.local.row_count("items") == n
    assert sorted(int(k) for x in seen for k in x["changedPks"]) == list(range(n)) and failed == seen
    parts = -(-n // most)
    assert [(x["rows"], x["part"], x["parts"]) for x in seen] == [(n, i, parts) for i in range(1, parts + 1)] and max(len(x["changedPks"]) for x in seen) == most
    e.pull()
    assert len(seen) == parts
    with pytest.raises(C.ConfigError):
        S.Engine(many, most_keys=0)


def test_parquet_store_versions(spark, tmp_path):
    s = parquet(spark, tmp_path / "s", A)
    before = s.table("items")
    s.replace("items", before.filter("id > 2"))
    assert before.count() == 4 and s.row_count("items") == 2  # a plan keeps its version
    with pytest.raises(C.ConcurrentWrite):
        s.publish(s.manifest()["tables"], s.version() - 1)
    assert s.vacuum(keep=1) and s.row_count("items") == 2
    with pytest.raises(C.ConfigError):
        ParquetStore(spark, "ftp://x/y")
    with pytest.raises(C.NotFound):
        ParquetStore(spark, str(tmp_path / "missing"))


def test_parquet_store_loses_no_writes(spark, tmp_path):
    a = parquet(spark, tmp_path / "s", A)
    b = ParquetStore(spark, str(tmp_path / "s"))
    mine, theirs = a.table("items"), b.table("items")
    b.add(TableSpec("other", ["id"]), theirs)
    a.replace("items", mine.filter("id > 1"))  # a commit of another table does no harm
    with pytest.raises(C.ConcurrentWrite):
        b.replace("items", theirs.filter("id > 2"))
    assert a.row_count("items") == 3 and a.list_tables() == ["items", "other"]


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s, seen, at = ParquetStore(spark, str(tmp_path / "s"), create=True), [], Files._at

    class Stream:
        def __init__(self, out):
            self.out, self.close = out, out.close

        def write(self, data):
            seen.append(s.manifest())
            self.out.write(data)

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def create(self, *args):
            return Stream(self.fs.create(*args))

    monkeypatch.setattr(Files, "_at", lambda self, path: (lambda fs, p: (Watched(fs), p))(*at(self, path)))
    s.publish({"t": {}}, 0)
    assert seen == [{"tables": {}}] and s.manifest() == {"tables": {"t": {}}}
    assert s.files.names(s.root) == ["_commits"]


def test_one_of_several_writers_creates_a_file(spark, tmp_path):
    files, start = Files(spark), Barrier(4)

    def create(mine):
        won = []
        for k in range(100):
            start.wait()
            won.append(files.create(f"{tmp_path}/s/_commits/{k}.json", mine))
        return won

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(create, "abcd"))
    assert [sum(x) for x in zip(*won, strict=True)] == [1] * 100
    assert all(files.read(f"{tmp_path}/s/_commits/{k}.json") == next(m for m, w in zip("abcd", won, strict=True) if w[k]) for k in range(100))


def test_tables_in_parallel(spark, tmp_path):
    a, b = (ParquetStore(spark, str(tmp_path / x), create=True) for x in "ab")
    for s, part in ((a, A), (b, B)):
        for n in ("t1", "t2", "t3"):
            s.add(TableSpec(n, ["id"], "updated_at"), spark.createDataFrame(part, ITEMS))
    out = S.sync_all(a, b, SyncConfig(), parallel=3)
    assert [(r.table, r.pushed, r.pulled) for r in out] == [(n, 3, 1) for n in ("t1", "t2", "t3")]
    assert all(rows(a, n) == rows(b, n) for n in ("t1", "t2", "t3"))


def test_sync_of_parquet_stores(spark, tmp_path):
    a, b = parquet(spark, tmp_path / "a", A), parquet(spark, tmp_path / "b", B)
    S.sync_all(a, b, SyncConfig())
    assert rows(a) == rows(b) and len(rows(a)) == 5


def test_stash_and_retrieve(spark, tmp_path):
    root, config = str(tmp_path / "relay"), SyncConfig(exclude_columns=["name"])
    a = store(spark, [(1, "alpha", "2024-01-01"), (2, "beta", "2024-01-02"), (3, "gamma", "2024-01-03")])
    with pytest.raises(C.NotFound):
        R.retrieve(spark, a, root, config)
    assert R.stash(spark, a, root, config)[0].pushed == 3
    version = ParquetStore(spark, root).version()
    assert R.stash(spark, a, root, config)[0].pushed == 0 and ParquetStore(spark, root).version() == version
    b = store(spark, [])
    assert R.retrieve(spark, b, root, config)[0].pulled == 3 and rows(b) == rows(a)
    c = store(spark, [(1, "new_name", "2024-01-02")])
    assert R.stash(spark, c, root, config, dry_run=True)[0].pushed == 1 and R.stash(spark, c, root, config)[0].pushed == 1
    with pytest.raises(C.NotFound):
        R.stash(spark, c, root, config, table="unknown")


def test_retrieve_reads_policies_from_the_relay(spark, tmp_path):
    root = str(tmp_path / "relay")
    R.stash(spark, store(spark, [(1, "relay", "2024-01-01")]), root, SyncConfig())
    here = store(spark, [(1, "here", "2024-01-01")])
    R.retrieve(spark, here, root, SyncConfig(conflict_resolution=C.ConflictPolicy.REMOTE_WINS))
    assert rows(here) == {(1, "here", "2024-01-01")}
    R.retrieve(spark, here, root, SyncConfig(conflict_resolution=C.ConflictPolicy.LOCAL_WINS))
    assert rows(here) == {(1, "relay", "2024-01-01")}


def test_snapshots(spark, tmp_path):
    s = parquet(spark, tmp_path / "s", A)
    first = R.snapshot(s, "2024-01-01T00:00:00.000Z")
    assert first["tables"] == [{"name": "items", "row_count": 4}] and first["size_bytes"] > 0
    s.replace("items", spark.createDataFrame([(99, "corrupt", "2024-06-01")], ITEMS))
    R.snapshot(s, "2024-02-01T00:00:00.000Z")
    s.files.create(f"{s.root}/_snapshots/broken.json", "{")
    assert [x["timestamp"][:7] for x in R.list_snapshots(s)] == ["2024-02", "2024-01"]
    assert R.restore(s, "2024-01-15T00:00:00.000Z")["timestamp"] == first["timestamp"]
    assert rows(s) == set(A)
    with pytest.raises(C.NotFound, match="2024-01-01"):
        R.restore(s, "2023")
    assert not [p for p in s.vacuum(keep=1) if not p]
    R.restore(s, "2024-03")
    assert rows(s) == {(99, "corrupt", "2024-06-01")}


def test_cache(spark, tmp_path):
    c = cache.MetadataCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(i, f"n{i}", f"2024-0{i}-01") for i in range(1, 6)], ITEMS)
    assert c.refresh("items", df, ["id"], "updated_at").count() == 5 and c.cursor("items") == "2024-05-01"
    more = df.unionByName(spark.createDataFrame([(6, "n6", "2024-06-01"), (7, "late", "2024-05-01"), (8, "missed", "2024-01-01")], ITEMS))
    assert c.refresh("items", more, ["id"], "updated_at").count() == 7 and c.cursor("items") == "2024-06-01"
    c.clear("items")
    assert c.load("items") is None
    strict = cache.since(more, "updated_at", "2024-05-01", strict=True)
    assert [r["id"] for r in strict.collect()] == [6]
    a, b = cache.MetadataCache(spark, str(tmp_path / "a")), cache.MetadataCache(spark, str(tmp_path / "b"))
    assert D.stats(cache.diff_cached(a, b, "items", df, more, ["id"], "updated_at")).first()["remote_only"] == 3


def test_peer_exchange(spark):
    users = "id string, name string, updated_at string"
    a, b = store(spark, [("1", "Alice", "1"), ("2", "Bob", "1")], users, "users"), store(spark, [("2", "Bob", "1"), ("3", "Carol", "1")], users, "users")
    assert peer.exchange(a, b, "users", SyncConfig()) == S.SyncResult("users", 1, 1)
    assert rows(a, "users") == rows(b, "users") and len(rows(a, "users")) == 3
    a, b = store(spark, [("1", "mine", "9")], users, "users"), store(spark, [("1", "theirs", "1")], users, "users")
    peer.exchange(a, b, "users", SyncConfig())
    assert rows(a, "users") == rows(b, "users") == {("1", "theirs", "1")}


def test_peers_that_must_not_exchange(spark):
    users = "id string, name string, updated_at string"
    a, b = store(spark, [("1", "x", "1"), ("1", "y", "1")], users, "users"), store(spark, [("2", "Bob", "1")], users, "users")
    for one, two in ((a, b), (b, a)):
        with pytest.raises(C.DuplicateKey):
            peer.exchange(one, two, "users", SyncConfig())
    with pytest.raises(C.SyncError, match="another database"):
        peer.exchange(b, b, "users", SyncConfig(), ("h1", "h2"))
    assert peer.exchange(b, b, "users", SyncConfig(), ("h1", "h1")) == S.SyncResult("users", 0, 0)


def test_columns_on_one_side_only(spark, caplog):
    """They are neither compared nor moved, so a drifted pair is at rest after one sync."""
    a = store(spark, [(1, "a", "1"), (2, "b", "1")])
    b = store(spark, [(1, "a", "1", 7)], ITEMS + ", extra int")
    got = [(r.pushed, r.pulled) for _ in range(3) for r in [S.sync_table(a, b, "items", SyncConfig())]]
    assert got == [(1, 0), (0, 0), (0, 0)] and rows(b) == {(1, "a", "1", 7), (2, "b", "1", None)} and "extra" in caplog.text
    c = store(spark, [("a", "1")], "name string, updated_at string")
    with pytest.raises(C.ConfigError, match="key column"):
        S.sync_table(a, c, "items", SyncConfig())


def test_relay_takes_new_columns(spark, tmp_path):
    root = str(tmp_path / "relay")
    R.stash(spark, store(spark, [(1, "a", "1"), (2, "b", "1")]), root, SyncConfig())
    wider = store(spark, [(1, "a", "2", 7), (2, "b", "1", None)], ITEMS + ", extra int")
    R.stash(spark, wider, root, SyncConfig())
    assert rows(ParquetStore(spark, root)) == {(1, "a", "2", 7), (2, "b", "1", None)}
    assert [r.pushed for r in R.stash(spark, wider, root, SyncConfig())] == [0]


def test_changed_rows_write_their_files_only(spark, tmp_path):
    """One row of a hundred key ranges: its range is written anew, ninety-nine are named again; the versions before stay readable."""
    s = ParquetStore(spark, str(tmp_path / "s"), create=True)
    df = spark.range(1000).selectExpr("id", "concat('n', id) AS name", "'1' AS updated_at").repartitionByRange(100, "id")
    s.add(TableSpec("items", ["id"], "updated_at"), df)
    before, old = s.manifest()["tables"]["items"], s.table("items")
    files = set(s.files_of(before))
    s.apply("items", spark.createDataFrame([(500, "new", "2")], ITEMS))
    after = set(s.files_of(s.manifest()["tables"]["items"]))
    assert len(files) == 100 and len(files - after) == 1
    assert spark.read.parquet(*(f"{s.root}/{f}" for f in after - files)).count() <= 12  # the range of the key, no other
    assert rows(s) == {(i, "new" if i == 500 else f"n{i}", "2" if i == 500 else "1") for i in range(1000)} and old.filter("name = 'new'").count() == 0
    s.apply("items", spark.createDataFrame([(5000, "more", "2")], ITEMS))
    assert after <= set(s.files_of(s.manifest()["tables"]["items"])) and s.row_count("items") == 1001
    a = store(spark, [(3, "pushed", "9")])
    assert S.push_table(a, s, "items", SyncConfig()).pushed == 1 and s.table("items").filter("name = 'pushed'").count() == 1
    s.compact("items")
    assert s.row_count("items") == 1001
    s.vacuum(1)
    assert s.row_count("items") == 1001


def test_two_writers_of_a_cache(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a", "1")], ITEMS)
    one, two = (cache.MetadataCache(spark, str(tmp_path / "c")) for _ in range(2))
    one.refresh("items", df, ["id"], "updated_at")
    seen = two._state("items")
    one.refresh("items", df, ["id"], "updated_at")
    monkeypatch.setattr(two, "_state", lambda table: seen)
    with pytest.raises(C.ConcurrentWrite):
        two.refresh("items", df, ["id"], "updated_at")
    assert one.load("items").count() == 1


def test_peers(spark):
    from pyspark.sql import functions as F

    seen = spark.createDataFrame([("me", "a", "h", 1, "2024-01-01 00:00:50"), ("b", "old", "h", 1, "2024-01-01 00:00:10"), ("b", "new", "h", 1, "2024-01-01 00:00:50"), ("c", "x", "h", 1, "2023-12-31 00:00:00"), ("d", "x", "h", 2, "2024-01-01 00:00:50")], "instance_id string, addr string, db_hash string, version int, last_seen string")
    live = peer.peers(seen, F.lit("2024-01-01 00:01:00").cast("timestamp"), 90, "me").collect()
    assert [(r["instance_id"], r["addr"]) for r in live] == [("b", "new")]


def test_packets():
    upserts = [{"id": str(i), "data": "x" * 500} for i in range(20)]
    parts = peer.split("me", 7, "t", upserts, ["del1"])
    assert len(parts) > 1 and all(p["total_parts"] == len(parts) for p in parts)
    assert [r for p in parts for r in p["upserts"]] == upserts and [p["deletes"] for p in parts][0] == ["del1"] and not any(p["deletes"] for p in parts[1:])
    assert all(peer.packet_bytes(p) <= peer.PACKET_BYTES or len(p["upserts"]) == 1 for p in parts)
    assert peer.split("me", 0, "t", [], ["d"])[0]["deletes"] == ["d"]
    with pytest.raises(C.SyncError):
        peer.split("me", 0, "t", [{"id": "1", "data": "x" * 70_000}], [])


@pytest.mark.parametrize("seqs, want", [([100, 50, 50, 30, 80], "TTFFT"), ([100, 36, 37], "TFT"), ([0, 200, 0, 200, 199], "TTFFT"), ([1, 1, 2, 1], "TFTF")])
def test_replay_guard(seqs, want):
    g = peer.ReplayGuard()
    assert "".join("FT"[g.accept(s)] for s in seqs) == want


def test_replay_guards_bounds():
    g = peer.ReplayGuards(most=2)
    assert g.accept("a", 1) and g.accept("b", 1) and not g.accept("c", 1) and not g.accept("x" * 200, 1)
    g.prune({"a"})
    assert g.accept("c", 1) and not g.accept("a", 1)


def test_batches(spark):
    make = lambda n, k: [{f"c{j}": i for j in range(k)} for i in range(n)]
    sizes = lambda n, k, size: [len(b) for b, _ in batching.greedy(make(n, k), [f"c{j}" for j in range(k)], size, 1 << 20)]
    assert sizes(10, 2, 3) == [3, 3, 3, 1] and sizes(25, 10, 100) == [10, 10, 5] and sizes(5, 50, 100) == [2, 2, 1] and sizes(3, 101, 100) == [1, 1, 1]
    assert [len(b) for b, _ in batching.greedy([{"a": "x" * 300}] * 4, ["a"], 100, 800)] == [1, 1, 1, 1]
    assert batching.insert_statement("t", ["a", "b"], [{"a": 1}, {"a": 2, "b": 3}]) == ('INSERT OR REPLACE INTO "t" ("a", "b") VALUES (?, ?), (?, ?)', [1, None, 2, 3])
    assert batching.max_rows_per_batch(100, 7) == 14 and batching.max_rows_per_batch(0, 7) is None
    df = spark.createDataFrame([(1, "abcdefghij", None, True)], "a long, b string, c string, d boolean")
    assert df.select(batching.row_bytes_column(df.schema, df.columns)).first()[0] == batching.row_bytes(df.first().asDict(), df.columns) == 6 + 19 + 9 + 10


def test_retry_and_errors():
    assert [C.Retry(initial_ms=1000, cap_ms=60_000).delay_ms(i) for i in range(5)] == [1000, 2000, 4000, 8000, 16000]
    assert [C.Retry(initial_ms=1000, cap_ms=5000).delay_ms(i) for i in range(5)] == [1000, 2000, 4000, 5000, 5000]
    assert C.Retry(multiplier=0.1).multiplier == 1.0 and C.Retry(initial_ms=1).delay_ms(10_000) == 30_000
    codes = {C.ConfigError("x"): 2, C.NetworkError("x"): 3, C.ConcurrentWrite("x"): 4, C.NotFound("x"): 5, C.PluginError("x"): 6, ValueError(): 1}
    assert all(C.exit_code(e) == n for e, n in codes.items())
    assert C.NetworkError("", 503).retryable and C.NetworkError("", 429, 2.5).retry_after_ms == 2500 and not C.NetworkError("", 404).retryable
    assert C.is_transient(C.ConcurrentWrite("x")) and not C.is_transient(C.PluginError("x"))


def test_config(tmp_path):
    c = C.Config.from_toml('local_db = "a.sqlite"\n[target]\ntype = "sqlite"\npath = "b.sqlite"\n[sync]\nconflict_resolution = "newer_wins"\nexclude_columns = ["*_v"]\n')
    assert c.resolved_target() == {"type": "sqlite", "path": "b.sqlite"} and c.sync.conflict_resolution is C.ConflictPolicy.NEWER_WINS and c.sync.excluded(["a_v", "b"]) == ["a_v"]
    assert C.Config.from_toml('database_id = "x"\napi_token = "t"\nurl = "u"').resolved_target() == {"type": "http", "profile": "d1", "auth_token": "t", "database_id": "x", "url": "u"}
    for bad in ('[sync]\nconflict_resolution = "nobody"', "[sync]\nunknown = 1", "x = ["):
        with pytest.raises(C.ConfigError):
            C.Config.from_toml(bad)
    with pytest.raises(C.ConfigError):
        C.Config.from_toml("[target]\ntype = 'plugin'").resolved_target()
    for name, size in (("a.sqlite", 10), ("b.sqlite", 20), ("c.sqlite", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert C.detect_local_db(str(tmp_path)).endswith("b.sqlite")
    assert peer.encryption_key("ab" * 32) == b"\xab" * 32 and peer.encryption_key(None) is None
    with pytest.raises(C.ConfigError):
        peer.encryption_key("zz")


def test_cli(spark, tmp_path, capsys):
    parquet(spark, tmp_path / "a", A)
    parquet(spark, tmp_path / "b", B)
    conf = tmp_path / "c.toml"
    conf.write_text(f'local = "{tmp_path}/a"\n[target]\ntype = "parquet"\npath = "{tmp_path}/b"\n[stash]\nurl = "{tmp_path}/relay"\n')

    def run(*args):
        code = cli.main(["--config", str(conf), "--output", "json", *args], spark)
        io = capsys.readouterr()
        return code, json.loads((io.out or io.err).strip().splitlines()[-1])

    assert run("diff")[1]["tables"][0]["local_only"] == 1
    assert run("sync", "--dry-run")[1]["total_rows_to_push"] == 3
    assert run("sync")[1]["tables"] == [{"name": "items", "rows_pushed": 3, "rows_pulled": 1}]
    assert run("status")[1]["tables"] == [{"side": s, "table": "items", "n_rows": 5} for s in ("local", "remote")]
    assert run("stash")[0] == 0 and run("snapshot")[0] == 0 and len(run("snapshots")[1]["snapshots"]) == 1
    assert run("retrieve")[1]["tables"] == [] and run("watch", "--ticks", "1", "--lock", str(tmp_path / "lock"))[1]["ticks"] == 1 and run("broadcast", "--once")[0] == 0
    assert run("restore", "1999")[0] == 5 and run("push", "--table", "none")[0] == 5
    assert cli.main(["--config", str(tmp_path / "missing"), "diff"], spark) == 2


def test_engine_with_kept_metadata(spark, tmp_path):
    caches = tuple(cache.MetadataCache(spark, str(tmp_path / x)) for x in "ab")
    a, b = parquet(spark, tmp_path / "sa", A), parquet(spark, tmp_path / "sb", B)
    plain = store(spark, A), store(spark, B)
    e = S.Engine(a, b, caches=caches)
    assert e.diff() == S.Engine(*plain).diff()
    assert [(r.pushed, r.pulled) for r in e.sync()] == [(r.pushed, r.pulled) for r in S.sync_all(*plain, SyncConfig())] == [(3, 1)]
    assert rows(a) == rows(b) == rows(plain[0])
    assert not any(r.has_changes for r in e.sync())  # what was sent is known, also where it is older than the cursor
    a.apply("items", spark.createDataFrame([(3, "newest", "2024-02-01")], ITEMS))
    assert [(r.pushed, r.pulled) for r in e.push()] == [(1, 0)] and (3, "newest", "2024-02-01") in rows(b)
    b.replace("items", b.table("items").filter("id <> 3"))
    assert e.diff()["items"]["local_only"] == 0  # a deletion is not seen
    e.clear_cache()
    assert e.diff()["items"]["local_only"] == 1
    other = parquet(spark, tmp_path / "sc", [])
    e.update_target(other)
    assert e.diff()["items"]["local_only"] == 5 and caches[0].load("items") is not None
    assert e.erase_local() == ["items"] and caches[0].load("items") is None


def test_kept_metadata_follows_the_columns(spark, tmp_path):
    c = cache.MetadataCache(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], ITEMS)
    one = {tuple(r) for r in c.refresh("items", df, ["id"], "updated_at").collect()}
    wider = df.selectExpr("*", "7 AS extra")
    assert {r["content_hash"] for r in c.refresh("items", wider, ["id"], "updated_at").collect()}.isdisjoint({r[-1] for r in one})
    assert {tuple(r) for r in c.refresh("items", df, ["id"], "updated_at").collect()} == one
    with pytest.raises(C.DuplicateKey):
        c.refresh("items", df.unionByName(df), ["id"], "updated_at")
    assert c.load("items").count() == 2


def test_update_auth(spark):
    class Service(MemoryStore):
        def set_token(self, token):
            self.token = token

    e = S.Engine(store(spark, A))
    with pytest.raises(C.NotFound):
        e.update_auth("t")
    e.update_target(store(spark, B))
    with pytest.raises(C.ConfigError):
        e.update_auth("t")
    e.update_target(Service({}, {}))
    e.update_auth("new")
    assert e.remote.token == "new"


@pytest.mark.parametrize("spans", [1, 7, 64])
def test_numbers_and_guards_by_ranges(spark, spans):
    """A hot table, a hot first column, nulls: the same as one window over each table."""
    import random

    rng = random.Random(spans)
    held = [(rng.choice(["hot"] * 5 + ["cold", None]), i, rng.randrange(300), rng.choice([None, "x", "x", "y"])) for i in range(600)]
    df = spark.createDataFrame(held, "source string, arrival long, seq long, kind string").repartition(5)
    got = {r["arrival"]: r["seq"] for r in peer.sequence_numbers(df.drop("seq"), "source", ["kind", "arrival"], spans).collect()}
    want = {}
    for name in ("hot", "cold", None):
        mine = sorted((x for x in held if x[0] == name), key=lambda x: (x[3] is not None, x[3] or "", x[1]))
        want |= {x[1]: k for k, x in enumerate(mine)}
    assert got == want
    verdicts = {r["arrival"]: r["accepted"] for r in peer.replay_accepted(df, "source", "seq", "arrival", spans).collect()}
    guards = {name: peer.ReplayGuard() for name in ("hot", "cold", None)}
    assert verdicts == {i: guards[s].accept(q) for s, i, q, _ in held}
    numbered = batching.batch_numbers(df, ["kind", "arrival"], 10, 4, spans).collect()
    line = sorted(held, key=lambda x: (x[3] is not None, x[3] or "", x[1]))
    assert {r["arrival"]: r["batch"] for r in numbered} == {x[1]: k // 10 for k, x in enumerate(line)}


def test_path_hashes(spark):
    from pyspark.sql import functions as F

    import hashlib

    assert spark.range(1).select(peer.db_hash(F.lit("/a/b.sqlite"))).first()[0] == hashlib.sha256(b"/a/b.sqlite").hexdigest()


def test_has_column(spark):
    s = store(spark, A)
    assert s.has_column("items", "name") and not s.has_column("items", "none")


def test_progress(spark):
    seen = []
    progress = S.Progress(lambda t, n: seen.append(("start", t, n)), lambda t, n: seen.append(("batch", t, n)), lambda t: seen.append(("finish", t)))
    S.sync_all(store(spark, A), store(spark, B), SyncConfig(), progress=progress)
    assert seen == [("start", "items", 3), ("batch", "items", 3), ("finish", "items"), ("start", "items", 1), ("batch", "items", 1), ("finish", "items")]
