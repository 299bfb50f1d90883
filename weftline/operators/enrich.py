"""Row enrichment by injected callables: language models and HTTP endpoints.

Side effects run at least once a row: Spark may repeat a task. Callers that
read a result twice write it first.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.json_tools import flatten_value
from weftline.plans.expressions import Compiler, columns_resolver

Transport = Callable[[dict], dict]


def template(parts: list[Mapping] | str | None, df: DataFrame):
    """A template as a Column: literal texts and expressions; nulls print empty."""
    if parts is None:
        return F.lit(None).cast("string")
    if isinstance(parts, str):
        return F.lit(parts)
    parts = parts["parts"] if isinstance(parts, Mapping) else parts
    compile_ = Compiler(columns_resolver(df.columns))
    return F.concat(*[F.lit(p["text"]) if p["kind"] == "literal" else F.coalesce(compile_(p["expr"]).cast("string"), F.lit("")) for p in parts])


def _extended(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    new = {n for n, _ in fields}
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema if f.name not in new] + [T.StructField(n, t, True) for n, t in fields])


def _cast(value, kind: T.DataType):
    if value is None:
        return None
    try:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return int(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else str(value).lower() == "true"
    except (TypeError, ValueError):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def llm_map(df: DataFrame, payload: Mapping, model: Callable[[dict], str]) -> DataFrame:
    """Each row with the fields of the model's JSON answer.

    ``outputSchema``: list of (name, Spark type). An answer that is no JSON
    object gives ``llm_error`` and the first 200 characters in ``llm_raw``.
    Equal values of ``cacheBy`` within a batch ask once.
    """
    fields = [(n, T._parse_datatype_string(t)) for n, t in payload["outputSchema"]]
    extra = [*fields, ("llm_error", T.StringType()), ("llm_raw", T.StringType())]
    schema = _extended(df, extra)
    cache_by = list(payload.get("cacheBy") or [])
    asked = df.withColumn("_prompt", template(payload["userPrompt"], df)).withColumn("_system", template(payload.get("systemPrompt"), df))
    settings = {k: payload[k] for k in ("model", "maxTokens", "temperature") if k in payload}
    names = [f.name for f in schema]

    def run(batches):
        for pdf in batches:
            known: dict[tuple, str] = {}
            out: dict[str, list] = {n: [] for n, _ in extra}
            for row in pdf.to_dict("records"):
                key = tuple(str(row[c]) for c in cache_by) if cache_by else (row["_system"], row["_prompt"])
                if key not in known:
                    known[key] = model({"prompt": row["_prompt"], "system": row["_system"], **settings})
                text = known[key]
                try:
                    answer = json.loads(text)
                    if not isinstance(answer, dict):
                        raise ValueError("not an object")
                    error = raw = None
                except ValueError as e:
                    answer, error, raw = {}, str(e), text[:200]
                for n, t in fields:
                    out[n].append(_cast(answer.get(n), t))
                out["llm_error"].append(error)
                out["llm_raw"].append(raw)
            yield pdf.drop(columns=["_prompt", "_system"], errors="ignore").assign(**{n: pd.Series(v, index=pdf.index, dtype=object) for n, v in out.items()})[names]

    return asked.mapInPandas(run, schema)


class AllFailed(RuntimeError):
    pass


def _send(transport: Transport, request: dict, policy: Mapping) -> dict:
    """The transport's answer, tried again with growing pauses."""
    tries = int(policy.get("maxRetries", 0)) + 1
    for i in range(tries):
        try:
            return transport(request)
        except Exception:
            if i + 1 == tries:
                raise
            time.sleep(float(policy.get("backoffMs", 100)) / 1000 * 2**i)
    raise AssertionError


class _Pace:
    """At most ``rate`` starts a second."""

    def __init__(self, rate: float | None):
        self.gap, self.next = (1 / rate if rate else 0), 0.0

    def wait(self) -> None:
        if self.gap:
            now = time.monotonic()
            if now < self.next:
                time.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap


def http_map(df: DataFrame, payload: Mapping, transport: Transport) -> DataFrame:
    """Each row with ``http_status`` and the answer's fields.

    ``transport(request) -> {"status": int, "body": any}``. Row mode sends a
    request a row (``concurrency`` at a time, ``rateLimitPerSecond`` a task);
    a failed row gets status error and ``http_error``, and only a task all of
    whose rows failed raises. ``batchMode`` sends lists of ``chunkSize`` rows,
    answer i belonging to row i, and raises on any failure. ``responseMode``
    array repeats the row for each element at ``responseRoot``.
    """
    fields = list(payload.get("outputFields") or [])
    extra = [(n, T.StringType()) for n in fields] + [("http_status", T.StringType()), ("http_error", T.StringType())]
    schema = _extended(df, extra)
    names = [f.name for f in schema]
    plain = list(df.columns)
    made = df.withColumn("_url", template(payload["url"], df))
    headers = dict(payload.get("headers") or {})
    auth = payload.get("auth") or {}
    compile_ = Compiler(columns_resolver(df.columns))
    for i, (k, v) in enumerate(headers.items()):
        made = made.withColumn(f"_h{i}", template(v, df))
    if auth:
        made = made.withColumn("_auth", compile_(auth["token"] if auth["kind"] == "bearer" else auth["value"]).cast("string"))
    body = payload.get("bodyFields") or plain
    made = made.withColumn("_body", F.to_json(F.struct(compile_(payload["body"]).alias("value"))) if payload.get("body") else F.to_json(F.struct(*[F.col(f"`{c}`") for c in body])))
    is_expr = bool(payload.get("body"))
    method, policy = payload.get("method", "GET"), dict(payload.get("retryPolicy") or {})
    as_array, root = payload.get("responseMode") == "array", payload.get("responseRoot")
    batch_mode, chunk = bool(payload.get("batchMode")), payload.get("chunkSize")
    workers, rate = int(payload.get("concurrency") or 1), payload.get("rateLimitPerSecond")
    header_names = list(headers)

    def request(row: dict, content) -> dict:
        h = {k: row[f"_h{i}"] for i, k in enumerate(header_names)}
        if auth:
            h["Authorization" if auth["kind"] == "bearer" else auth["header"]] = f"Bearer {row['_auth']}" if auth["kind"] == "bearer" else row["_auth"]
        return {"url": row["_url"], "method": method, "headers": h, "body": None if method == "GET" else content}

    def content(row: dict):
        v = json.loads(row["_body"])
        return v.get("value") if is_expr else v

    def answer(row: dict, status: int, value) -> list[dict]:
        if as_array:
            for p in (root or "").split("."):
                value = value.get(p) if p and isinstance(value, dict) else value if not p else None
            values = value if isinstance(value, list) else [] if value is None else [value]
        else:
            values = [value]
        out = []
        for v in values:
            flat = flatten_value(v) if isinstance(v, dict) else {"value": None if v is None else str(v)}
            out.append({**{c: row[c] for c in plain}, **{f: flat.get(f) for f in fields}, "http_status": str(status), "http_error": None})
        return out

    def run(batches):
        tried = failed = 0
        last = None
        pace = _Pace(rate)

        def one(row: dict) -> list[dict]:
            nonlocal tried, failed, last
            tried += 1
            try:
                pace.wait()
                got = _send(transport, request(row, content(row)), policy)
                if int(got["status"]) >= 400:
                    raise RuntimeError(f"HTTP {got['status']}")
                return answer(row, got["status"], got.get("body"))
            except Exception as e:
                failed += 1
                last = str(e)
                return [{**{c: row[c] for c in plain}, **dict.fromkeys(fields), "http_status": "error", "http_error": str(e)}]

        for pdf in batches:
            rows = pdf.to_dict("records")
            out: list[dict] = []
            if batch_mode:
                step = int(chunk or max(1, len(rows)))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    pace.wait()
                    got = _send(transport, request(part[0], [content(r) for r in part]), policy)
                    if int(got["status"]) >= 400:
                        raise RuntimeError(f"HTTP {got['status']}")
                    values = got.get("body")
                    for i, r in enumerate(part):
                        out += answer(r, got["status"], values[i] if isinstance(values, list) and i < len(values) else None)
            elif workers > 1:
                with ThreadPoolExecutor(workers) as pool:
                    for r in pool.map(one, rows):
                        out += r
            else:
                for r in rows:
                    out += one(r)
            yield pd.DataFrame(out, columns=names)
        if tried and tried == failed:
            raise AllFailed(f"all {tried} requests failed: {last}")

    return made.mapInPandas(run, schema)
