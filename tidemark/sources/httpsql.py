"""SQL over HTTP: request and response shapes of several services, a client, a store, and plugins."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.functions.globs import user_tables
from tidemark.operators import merge as M
from tidemark.operators.batching import insert_statement, max_rows_per_batch, quoted
from tidemark.plans.config import ConfigError, NetworkError, NotFound, PluginError, Retry

from .sqlite import KINDS, to_kind, to_sqlite
from .store import Store, TableSpec


@dataclass(frozen=True)
class Profile:
    """How a service wants its requests and where its answers hold rows and columns."""

    auth: str
    shape: str
    rows: tuple
    columns: tuple
    bind_limit: int = 0


#: Fixed values of the services' interfaces.
PROFILES = {
    "turso": Profile("bearer", "pipeline", ("results", 0, "response", "result", "rows"), ("results", 0, "response", "result", "cols")),
    "rqlite": Profile("basic", "nested", ("results", 0, "values"), ("results", 0, "columns")),
    "d1": Profile("bearer", "flat", ("result", 0, "results"), ("result", 0, "results"), 100),
    "datasette": Profile("bearer", "bare", ("rows",), ("columns",)),
    "sqlite-cloud": Profile("bearer", "flat", ("data",), ("columns",)),
    "starbasedb": Profile("bearer", "flat", ("result",), ("columns",)),
    "generic": Profile("bearer", "flat", ("rows",), ("columns",)),
}
ALIASES = {"libsql": "turso", "cloudflare-d1": "d1", "sqlitecloud": "sqlite-cloud", "starbase": "starbasedb"}


def profile(name: str) -> Profile:
    try:
        return PROFILES[ALIASES.get(name, name)]
    except KeyError:
        raise ConfigError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}") from None


def _typed(value) -> dict:
    if value is None:
        return {"type": "null"}
    if isinstance(value, int) and not isinstance(value, bool):
        return {"type": "integer", "value": str(value)}
    if isinstance(value, float):
        return {"type": "float", "value": value}
    return {"type": "text", "value": value if isinstance(value, str) else json.dumps(value)}


def build_request(p: Profile, sql: str, params: list | None = None):
    """The JSON body of one statement."""
    params = params or []
    if p.shape == "pipeline":
        return {"requests": [{"type": "execute", "stmt": {"sql": sql} | ({"args": [_typed(v) for v in params]} if params else {})}]}
    if p.shape == "nested":
        return [[sql, *params]]
    if p.shape == "bare":
        if params:
            raise ConfigError("this service takes no parameters")
        return {"sql": sql, "_shape": "array"}
    return {"sql": sql} | ({"params": params} if params else {})


def extract(root, path: tuple):
    """The value at a path of keys and places, None if there is none."""
    for step in path:
        if isinstance(step, int):
            root = root[step] if isinstance(root, list) and step < len(root) else None
        else:
            root = root.get(step) if isinstance(root, dict) else None
        if root is None:
            return None
    return root


def answer_rows(p: Profile, answer) -> list[dict]:
    """Rows as dicts, from rows that are objects or arrays, and columns that are names or objects with one."""
    rows = extract(answer, p.rows)
    if rows is None:
        rows = answer if isinstance(answer, list) else []
    if not rows:
        return []
    plain = lambda v: v.get("value") if isinstance(v, dict) and "type" in v else v
    if isinstance(rows[0], dict):
        return [{k: plain(v) for k, v in r.items()} for r in rows]
    columns = [c.get("name") if isinstance(c, dict) else c for c in extract(answer, p.columns) or []]
    return [dict(zip(columns, map(plain, r), strict=True)) for r in rows]


class Client:
    """One service; transient failures are tried again after growing delays."""

    def __init__(self, url: str, kind: str = "generic", token: str | None = None, retry: Retry | None = None, send: Callable | None = None, sleep: Callable = time.sleep):
        self.url, self.kind, self.profile, self.token = url, kind, profile(kind), token
        self.retry, self._send, self._sleep = retry or Retry(), send, sleep

    def options(self) -> dict[str, str]:
        """What rebuilds the client on an executor."""
        r = self.retry
        return {"url": self.url, "profile": self.kind, "token": self.token or "", "retry": json.dumps([r.max_retries, r.initial_ms, r.cap_ms, r.multiplier])}

    @classmethod
    def from_options(cls, options: dict) -> Client:
        return cls(options["url"], options.get("profile", "generic"), options.get("token") or None, Retry(*json.loads(options["retry"])) if "retry" in options else None)

    def headers(self) -> dict:
        out = {"Content-Type": "application/json"}
        if self.token:
            out["Authorization"] = f"Bearer {self.token}" if self.profile.auth == "bearer" else "Basic " + base64.b64encode(self.token.encode()).decode()
        return out

    def _post(self, body) -> object:
        if self._send:
            return self._send(self.url, self.headers(), body)
        request = urllib.request.Request(self.url, json.dumps(body).encode(), self.headers(), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After", "")
            raise NetworkError(f"{e.code}: {e.read()[:200]!r}", e.code, float(after) if after.isdigit() else None) from None
        except TimeoutError:
            raise NetworkError("timed out", timeout=True) from None
        except urllib.error.URLError as e:
            raise NetworkError(str(e.reason)) from None

    def execute(self, sql: str, params: list | None = None) -> list[dict]:
        body = build_request(self.profile, sql, params)
        for attempt in range(self.retry.max_retries + 1):
            try:
                return answer_rows(self.profile, self._post(body))
            except NetworkError as e:
                if not e.retryable or attempt == self.retry.max_retries:
                    raise
                self._sleep((e.retry_after_ms if e.retry_after_ms is not None else self.retry.delay_ms(attempt)) / 1000)
        raise AssertionError


class Pages(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class HttpReader(DataSourceReader):
    """Rows in the order of the key, pages of them per partition; each partition asks for its own."""

    def __init__(self, options: dict, schema: T.StructType):
        self.client, self.schema, self.name = Client.from_options(options), schema, options["table"]
        self.order, self.page, self.parts = options["order"], int(options.get("page", 1000)), int(options.get("partitions", 8))

    def partitions(self):
        total = row_count(self.client, self.name)
        pages = max(1, -(-total // self.page))
        step = -(-pages // self.parts) * self.page
        return [Pages(a, a + step) for a in range(0, max(1, total), step)]

    def read(self, part):
        for at in range(part.start, part.stop, self.page):
            rows = self.client.execute(f"SELECT * FROM {quoted(self.name)} ORDER BY {self.order} LIMIT {self.page} OFFSET {at}")
            for r in rows:
                yield tuple(to_kind(r.get(f.name), f.dataType) for f in self.schema)
            if len(rows) < self.page:
                return


class HttpWriter(DataSourceWriter):
    """Statements within the bind limit, sent by the partition that holds the rows; repeating them changes nothing."""

    def __init__(self, options: dict, schema: T.StructType):
        self.client, self.columns, self.name = Client.from_options(options), schema.names, options["table"]

    def write(self, rows):
        most = max_rows_per_batch(self.client.profile.bind_limit, len(self.columns)) or 100
        held: list[dict] = []
        for row in rows:
            held.append({c: to_sqlite(v) for c, v in zip(self.columns, row, strict=True)})
            if len(held) >= most:
                self.client.execute(*insert_statement(self.name, self.columns, held))
                held = []
        if held:
            self.client.execute(*insert_statement(self.name, self.columns, held))
        return WriterCommitMessage()


class HttpSource(DataSource):
    """``spark.read.format("tidemark_http")`` with ``url``, ``profile``, ``token``, ``table`` and ``order``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_http"

    def schema(self) -> T.StructType:
        return table_info(Client.from_options(dict(self.options)), self.options["table"])[0]

    def reader(self, schema):
        return HttpReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ConfigError("a service's table is only added to")
        return HttpWriter(dict(self.options), schema)


def row_count(client: Client, name: str) -> int:
    return int(next(iter(client.execute(f"SELECT COUNT(*) AS n FROM {quoted(name)}")[0].values())))


def table_info(client: Client, name: str) -> tuple[T.StructType, list[str]]:
    schema, pk = T.StructType(), []
    for r in client.execute(f"PRAGMA table_info({quoted(name)})"):
        schema.add(r["name"], next((t for mark, t in KINDS if mark in (r.get("type") or "").upper()), T.StringType()), True)
        if int(r.get("pk") or 0):
            pk.append(r["name"])
    if not schema.names:
        raise NotFound(f"no table {name!r}")
    return schema, pk


class HttpStore(Store):
    """The tables of a service, read and written by the executors; schemas are asked for once."""

    def __init__(self, spark: SparkSession, client: Client, ts_col: str | None = None, page: int = 1000, partitions: int = 8):
        spark.dataSource.register(HttpSource)
        self.spark, self.client, self.ts_col = spark, client, ts_col
        self._options = client.options() | {"page": str(page), "partitions": str(partitions)}
        self._info: dict[str, tuple[T.StructType, list[str]]] = {}

    def set_token(self, token: str | None) -> None:
        self.client.token = token
        self._options["token"] = token or ""

    def list_tables(self) -> list[str]:
        return user_tables(r["name"] for r in self.client.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name"))

    def _table_info(self, name: str) -> tuple[T.StructType, list[str]]:
        if name not in self._info:
            self._info[name] = table_info(self.client, name)
        return self._info[name]

    def spec(self, name: str) -> TableSpec:
        schema, pk = self._table_info(name)
        return TableSpec(name, pk, self.ts_col if self.ts_col in schema.names else None)

    def row_count(self, name: str) -> int:
        return row_count(self.client, name)

    def table(self, name: str) -> DataFrame:
        schema, pk = self._table_info(name)
        order = ", ".join(map(quoted, pk)) or "1"
        return self.spark.read.format("tidemark_http").schema(schema).options(**self._options, table=name, order=order).load()

    def upsert(self, name: str, rows: DataFrame) -> None:
        rows.write.format("tidemark_http").mode("append").options(**self._options, table=name, order="1").save()

    def apply(self, name: str, rows: DataFrame, keys: DataFrame | None = None, mode: str = "preserve") -> None:
        """Send the rows, each statement by its key; of the service's own rows only columns that do not come in are read."""
        schema, pk = self._table_info(name)
        whole = {*schema.names} <= {*rows.columns} or mode == "replace"
        target = self.spark.createDataFrame([], schema) if whole else self.table(name)
        self.upsert(name, M.completed(target, rows, pk, mode))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Send the rows that are new or changed; a service keeps what it is not told about."""
        old = self.table(name)
        self.upsert(name, rows.select(*old.columns).subtract(old))


def serve(adapter, lines=None, out=None) -> None:
    """Answer requests line by line until the input ends."""
    import sys

    for line in lines or sys.stdin:
        if line.strip():
            print(dispatch(adapter, line), file=out or sys.stdout, flush=True)


# -- plugins --------------------------------------------------------------------------------------------------------

#: Fixed values of the line protocol.
PARSE_ERROR, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32601, -32602, -32000
METHODS = ("initialize", "list_tables", "table_info", "get_row_metadata", "get_rows", "upsert_rows", "row_count")


def dispatch(adapter, line: str) -> str:
    """Answer one request line with one line."""
    number = None

    def failed(code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}})

    try:
        request = json.loads(line)
        number = request.get("id")
    except (ValueError, AttributeError):
        return failed(PARSE_ERROR, "not a request")
    method = request.get("method")
    call = getattr(adapter, method, None) if method in METHODS else None
    if call is None:
        return failed(NO_METHOD, f"no method {method!r}")
    params = request.get("params") or {}
    if not isinstance(params, dict):
        return failed(BAD_PARAMS, "parameters are named")
    try:
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": call(**params)})
    except TypeError as e:
        return failed(BAD_PARAMS, str(e))
    except Exception as e:
        return failed(FAILED, str(e))


class PluginClient:
    """The other end: a child process that answers lines."""

    def __init__(self, command: list[str]):
        import subprocess

        try:
            self._child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        except OSError as e:
            raise PluginError(str(e)) from None
        self._n = 0

    def call(self, method: str, **params):
        self._n += 1
        self._child.stdin.write(json.dumps({"jsonrpc": "2.0", "id": self._n, "method": method, "params": params}) + "\n")
        self._child.stdin.flush()
        line = self._child.stdout.readline()
        if not line:
            raise PluginError(f"the plugin ended during {method}")
        answer = json.loads(line)
        if answer.get("id") != self._n or "error" in answer:
            raise PluginError(str(answer.get("error", "answer out of turn")))
        return answer.get("result")

    def close(self) -> None:
        self._child.kill()
        self._child.wait()


class PluginStore(Store):
    """The tables that a plugin serves; its rows pass through the driver, as its one pipe does."""

    def __init__(self, spark: SparkSession, client: PluginClient, options: dict | None = None, ts_col: str = "updated_at", batch: int = 100):
        self.spark, self.client, self.ts_col, self.batch = spark, client, ts_col, batch
        client.call("initialize", config=options or {})

    def list_tables(self) -> list[str]:
        return user_tables(self.client.call("list_tables"))

    def _info(self, name: str) -> tuple[T.StructType, list[str]]:
        info = self.client.call("table_info", table=name)
        kinds = {c["name"]: next((t for mark, t in KINDS if mark in str(c.get("type", "")).upper()), T.StringType()) for c in info["columns"]}
        return T.StructType([T.StructField(k, t) for k, t in kinds.items()]), list(info["primary_key"])

    def spec(self, name: str) -> TableSpec:
        schema, pk = self._info(name)
        return TableSpec(name, pk, self.ts_col if self.ts_col in schema.names else None)

    def row_count(self, name: str) -> int:
        return int(self.client.call("row_count", table=name))

    def table(self, name: str) -> DataFrame:
        schema, _ = self._info(name)
        keys = sorted(self.client.call("get_row_metadata", table=name, timestamp_column=self.ts_col, exclude_columns=[]))
        out = []
        for at in range(0, len(keys), self.batch):
            out += [tuple(to_kind(r.get(f.name), f.dataType) for f in schema) for r in self.client.call("get_rows", table=name, pk_values=keys[at : at + self.batch])]
        return self.spark.createDataFrame(out, schema)

    def replace(self, name: str, rows: DataFrame) -> None:
        self._send(name, rows.subtract(self.table(name)))

    def apply(self, name: str, rows: DataFrame, keys: DataFrame | None = None, mode: str = "preserve") -> None:
        """Send the rows; of the plugin's own rows only columns that do not come in are read."""
        schema, pk = self._info(name)
        whole = {*schema.names} <= {*rows.columns} or mode == "replace"
        self._send(name, M.completed(self.spark.createDataFrame([], schema) if whole else self.table(name), rows, pk, mode))

    def _send(self, name: str, rows: DataFrame) -> None:
        held: list[dict] = []
        for row in rows.toLocalIterator():
            held.append({k: to_sqlite(v) for k, v in row.asDict().items()})
            if len(held) == self.batch:
                self.client.call("upsert_rows", table=name, rows=held)
                held = []
        if held:
            self.client.call("upsert_rows", table=name, rows=held)


def plugin_path(name: str, folders: list[str]) -> str:
    """The first executable of that name."""
    import os
    import shutil

    for folder in folders:
        path = os.path.join(folder, name)
        if os.access(path, os.X_OK) and os.path.isfile(path):
            return path
    found = shutil.which(name)
    if not found:
        raise PluginError(f"no plugin {name!r}")
    return found
