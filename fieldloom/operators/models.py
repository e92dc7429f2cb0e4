"""Around model calls: a request log without secrets, replies read tolerantly, providers run as commands."""

from __future__ import annotations

import json
import re
import shlex
import subprocess
import urllib.request
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from pathlib import Path

from fieldloom.config import redact
from fieldloom.operators.embed import Provider, checked

#: fixed values: header and query names whose values are never logged
SECRET_HEADERS = ("authorization", "x-api-key", "api-key", "cookie", "proxy-authorization")
_QUERY = re.compile(r"(?i)([?&](?:key|api_?key|token|access_token|secret|signature|sig|password)=)[^&#\s]+")


def redact_headers(headers: Mapping[str, str]) -> dict[str, str]:
    return {k: "***" if k.lower() in SECRET_HEADERS else v for k, v in headers.items()}


def redact_url(url: str) -> str:
    return _QUERY.sub(r"\1***", re.sub(r"(//[^:/@\s]+:)[^@\s]+@", r"\1***@", url))


def brief(reply: object, limit: int = 500) -> object:
    """A reply's shape: long texts clipped, long lists counted, vectors by their length."""
    if isinstance(reply, str):
        return reply if len(reply) <= limit else reply[:limit] + "..."
    if isinstance(reply, Mapping):
        return {k: brief(v, limit) for k, v in reply.items()}
    if isinstance(reply, list):
        if len(reply) > 8 and all(isinstance(x, (int, float)) for x in reply):
            return f"vector of {len(reply)}"
        return [brief(x, limit) for x in reply[:8]] + ([f"{len(reply) - 8} more"] if len(reply) > 8 else [])
    return reply


def log_request(path: str | Path, kind: str, url: str, headers: Mapping[str, str], request: object, reply: object = None, error: str | None = None) -> None:
    """Append one line; the folder is made where it is missing."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    row = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "kind": kind, "url": redact_url(url), "headers": redact_headers(headers), "request": brief(redact(request)), "reply": brief(reply), "error": error}
    with p.open("a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False) + "\n")


def rerank_scores(reply: Mapping, n: int) -> list[float]:
    """Scores by document index from a reply of any usual shape; documents it leaves out score 0."""
    out = [0.0] * n
    inner = reply.get("output") if isinstance(reply.get("output"), Mapping) else reply
    rows = next((inner[k] for k in ("results", "data", "rankings") if isinstance(inner.get(k), list)), [])
    for r in rows:
        if isinstance(r, Mapping) and isinstance(i := r.get("index"), int) and 0 <= i < n:
            out[i] = float(r.get("relevance_score", r.get("score", 0.0)) or 0.0)
    return out


def rerank_results(reply: Mapping, n: int, top_n: int | None = None) -> list[tuple[int, float]]:
    """(index, score) of the documents that a reply names, from the best down, equal scores by index, at most top_n."""
    inner = reply.get("output") if isinstance(reply.get("output"), Mapping) else reply
    rows = next((inner[k] for k in ("results", "data", "rankings") if isinstance(inner.get(k), list)), [])
    named = {r["index"] for r in rows if isinstance(r, Mapping) and isinstance(r.get("index"), int) and 0 <= r["index"] < n}
    scores = rerank_scores(reply, n)
    return sorted(((i, scores[i]) for i in named), key=lambda x: (-x[1], x[0]))[:top_n]


def http_provider(url: str, model: str, key: str | None = None, batch: int = 10, timeout: float = 180, post: Callable[[str, dict, dict, float], Mapping] | None = None) -> Provider:
    """Embeddings from an address that takes {"model", "input"} and returns {"data": [{"index", "embedding"}]}. post can be replaced, as in tests."""
    send = post or _post

    def run(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), batch):
            some = texts[at : at + batch]
            reply = send(url, {"Authorization": f"Bearer {key}"} if key else {}, {"model": model, "input": some}, timeout)
            rows = sorted((r for r in reply.get("data") or [] if isinstance(r, Mapping)), key=lambda r: r.get("index", 0))
            out += checked([r.get("embedding") or [] for r in rows], len(some))
        return checked(out, len(texts))

    return run


def _post(url: str, headers: dict, body: dict, timeout: float) -> Mapping:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def reranker(call: Callable[[str, list[str]], Mapping], text: Callable[[dict], str], chars: int = 2000) -> Callable[[str, list[dict]], list[float]]:
    """A pipeline's rerank hook from a client that takes a question and texts."""
    return lambda query, hits: rerank_scores(call(query, [text(h)[:chars] for h in hits]), len(hits))


def command_provider(command: str, timeout: float = 120) -> Provider:
    """Embeddings from a program that reads {"texts": [...]} and writes {"embeddings": [...]}."""

    def run(texts: list[str]) -> list[list[float]]:
        done = subprocess.run(shlex.split(command), input=json.dumps({"texts": texts}), capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"the provider ended with {done.returncode}: {done.stderr[:200]}")
        return checked(json.loads(done.stdout)["embeddings"], len(texts))

    return run
