import json
import sqlite3
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sync as S
from tidemark.plans import config as C
from tidemark.sources import httpsql as H
from tidemark.sources.sqlite import SqliteStore


def database(path, rows):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT NOT NULL, weight REAL, raw BLOB, updated_at TEXT)")
    con.execute("CREATE TABLE _cf_KV (k TEXT)")
    con.execute("CREATE TABLE pairs (b INTEGER, a INTEGER, v TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID")
    con.execute("INSERT INTO pairs VALUES (1, 2, 'x')")
    con.executemany("INSERT INTO items VALUES (?, ?, ?, ?, ?)", rows)
    con.commit()
    con.close()
    return str(path)


def test_sqlite_keeps_its_rows_if_a_write_fails(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
        con.executemany("INSERT INTO items VALUES (?, ?)", [(i, f"n{i}") for i in range(10)])
    s = SqliteStore(spark, path)
    bad = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    for write in (s.replace, s.apply):
        with pytest.raises(Exception, match="NOT NULL"):
            write("items", bad)
        assert s.row_count("items") == 10 and s.table("items").filter("name = 'x'").count() == 0
    assert s.list_tables() == ["items"]
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table'").fetchone() == (1,)
    s.apply("items", spark.createDataFrame([(1, "x"), (11, "y")], "id long, name string"))
    assert s.row_count("items") == 11


def test_sqlite_store(spark, tmp_path):
    a = SqliteStore(spark, database(tmp_path / "a.sqlite", [(i, f"n{i}", i / 2, b"\xde", "2024") for i in range(1, 30)]), "updated_at")
    b = SqliteStore(spark, database(tmp_path / "b.sqlite", [(1, "old", None, None, "2023"), (100, "only", 1.0, b"", "2024")]), "updated_at")
    assert a.list_tables() == ["items", "pairs"] and a.spec("pairs").pk == ["b", "a"] and a.spec("items").ts_col == "updated_at"
    assert a.table("items").count() == a.row_count("items") == 29 and a.table("pairs").first()["v"] == "x"
    out = {r.table: r for r in S.sync_all(a, b, C.SyncConfig())}
    assert (out["items"].pushed, out["items"].pulled) == (29, 1)
    assert {tuple(r) for r in a.table("items").collect()} == {tuple(r) for r in b.table("items").collect()} and b.row_count("items") == 30
    with pytest.raises(C.NotFound):
        SqliteStore(spark, str(tmp_path / "missing.sqlite"))


@pytest.mark.parametrize(
    "name, body",
    [
        ("libsql", {"requests": [{"type": "execute", "stmt": {"sql": "q", "args": [{"type": "integer", "value": "1"}, {"type": "null"}, {"type": "text", "value": "a"}, {"type": "float", "value": 1.5}]}}]}),
        ("rqlite", [["q", 1, None, "a", 1.5]]),
        ("d1", {"sql": "q", "params": [1, None, "a", 1.5]}),
        ("starbase", {"sql": "q", "params": [1, None, "a", 1.5]}),
    ],
)
def test_requests(name, body):
    assert H.build_request(H.profile(name), "q", [1, None, "a", 1.5]) == body


def test_request_without_parameters():
    assert H.build_request(H.profile("datasette"), "q") == {"sql": "q", "_shape": "array"} and H.build_request(H.profile("rqlite"), "q") == [["q"]]
    with pytest.raises(C.ConfigError):
        H.build_request(H.profile("datasette"), "q", [1])
    with pytest.raises(C.ConfigError):
        H.profile("nobody")


def test_answers():
    want = [{"a": 1, "b": "x"}]
    assert H.answer_rows(H.profile("turso"), {"results": [{"response": {"result": {"cols": [{"name": "a"}, {"name": "b"}], "rows": [[1, {"type": "text", "value": "x"}]]}}}]}) == want
    assert H.answer_rows(H.profile("rqlite"), {"results": [{"columns": ["a", "b"], "values": [[1, "x"]]}]}) == want
    assert H.answer_rows(H.profile("d1"), {"result": [{"results": want}]}) == want
    assert H.answer_rows(H.profile("generic"), {}) == []


@pytest.fixture
def service(tmp_path):
    """A stub of a service over an SQLite file; it is busy at the first request."""
    path, sent, busy = database(tmp_path / "h.sqlite", [(i, f"n{i}", 1.0, None, "2024") for i in range(7)]), [], [503]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = busy.pop() if busy else 200 if self.headers["Authorization"] == "Bearer t" else 401
            out = {}
            if code == 200:
                sent.append(body)
                with sqlite3.connect(path, timeout=30) as con:
                    con.row_factory = sqlite3.Row
                    out = {"result": [{"results": [dict(r) for r in con.execute(body["sql"], body.get("params", []))]}]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", sent
    server.shutdown()


def test_http_store(spark, service):
    url, sent = service
    store = H.HttpStore(spark, H.Client(url, "d1", "t", C.Retry(initial_ms=1)), "updated_at", page=3, partitions=2)
    assert store.list_tables() == ["items", "pairs"] and store.spec("items").pk == ["id"] and store.row_count("items") == 7
    assert sorted(r["id"] for r in store.table("items").collect()) == list(range(7)) and store.table("items").rdd.getNumPartitions() == 2
    assert store.table("pairs").first()["v"] == "x"
    store.upsert("items", spark.createDataFrame([(i, "new", 2.0, None, "2025") for i in range(50)], store.table("items").schema).coalesce(1))
    assert sorted(len(b["params"]) for b in sent if b["sql"].startswith("INSERT")) == [50, 100, 100] and store.row_count("items") == 50
    from tidemark.sources.store import MemoryStore, TableSpec

    local = MemoryStore({"items": store.table("items").filter("id < 10").withColumn("name", F.lit("mine"))}, {"items": TableSpec("items", ["id"], "updated_at")})
    local = MemoryStore({"items": spark.createDataFrame(local.table("items").collect(), store.table("items").schema)}, {"items": TableSpec("items", ["id"], "updated_at")})
    out = S.sync_all(local, store, C.SyncConfig())[0]
    assert (out.pushed, out.pulled) == (10, 40) and {r["name"] for r in store.table("items").filter("id < 10").collect()} == {"mine"}
    with pytest.raises(C.NetworkError):
        H.Client(url, "d1", "wrong", C.Retry(max_retries=0)).execute("SELECT 1")
    with pytest.raises(C.NetworkError):
        H.Client("http://x", send=lambda *_: (_ for _ in ()).throw(C.NetworkError("no", 400))).execute("q")


class Adapter:
    def list_tables(self):
        return ["t"]

    def row_count(self, table):
        if table == "bad":
            raise ValueError("no such table")
        return 3


def test_plugin_protocol(tmp_path):
    ask = lambda **r: json.loads(H.dispatch(Adapter(), json.dumps({"jsonrpc": "2.0", "id": 1} | r)))
    assert ask(method="list_tables")["result"] == ["t"] and ask(method="row_count", params={"table": "t"})["result"] == 3
    codes = [ask(method="nope"), ask(method="row_count", params={"x": 1}), ask(method="row_count", params={"table": "bad"}), json.loads(H.dispatch(Adapter(), "{"))]
    assert [c["error"]["code"] for c in codes] == [-32601, -32602, -32000, -32700]
    child = tmp_path / "child.py"
    child.write_text("import sys, json\nfor line in sys.stdin:\n    r = json.loads(line)\n    print(json.dumps({'id': r['id'], 'result': r['method']}), flush=True)\n")
    client = H.PluginClient([sys.executable, str(child)])
    assert client.call("list_tables") == "list_tables"
    client.close()
    with pytest.raises(C.PluginError):
        H.plugin_path("no-such-plugin", [str(tmp_path)])


PLUGIN = """#!{python}
import sys
sys.path.insert(0, {root!r})
from tidemark.sources.httpsql import serve
rows = {{str(i): {{"id": i, "name": f"n{{i}}", "updated_at": "1"}} for i in range(5)}}
class Store:
    def initialize(self, config): return {{}}
    def list_tables(self): return ["items"]
    def table_info(self, table): return {{"name": table, "columns": [{{"name": "id", "type": "INTEGER"}}, {{"name": "name", "type": "TEXT"}}, {{"name": "updated_at", "type": "TEXT"}}], "primary_key": ["id"]}}
    def get_row_metadata(self, table, timestamp_column, exclude_columns): return {{k: {{"pk_value": k}} for k in rows}}
    def get_rows(self, table, pk_values): return [rows[k] for k in pk_values]
    def upsert_rows(self, table, rows):
        globals()["rows"].update({{str(r["id"]): r for r in rows}})
        return len(rows)
    def row_count(self, table): return len(rows)
serve(Store())
"""


def test_plugin_store(spark, tmp_path):
    from pathlib import Path

    from tidemark.sources.store import MemoryStore, TableSpec

    path = tmp_path / "plugin"
    path.write_text(PLUGIN.format(python=sys.executable, root=str(Path(__file__).resolve().parent.parent)))
    path.chmod(0o755)
    client = H.PluginClient([H.plugin_path("plugin", [str(tmp_path)])])
    try:
        store = H.PluginStore(spark, client, batch=2)
        local = MemoryStore({"items": spark.createDataFrame([(1, "new", "2"), (9, "x", "1")], "id long, name string, updated_at string")}, {"items": TableSpec("items", ["id"])})
        out = S.sync_all(local, store, C.SyncConfig())[0]
        assert (out.pushed, out.pulled) == (2, 4) and store.row_count("items") == 6
        assert {tuple(r) for r in store.table("items").collect()} == {tuple(r) for r in local.table("items").collect()}
    finally:
        client.close()
