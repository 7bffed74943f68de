"""JSON as language models write it: repaired, checked against a contract, else null."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_TYPE = "struct<id: string, datetime: string, proposition: string, caused_by: array<string>, caused: array<string>, subgraph_type: string>"


def repair(text: str | None) -> Any:
    """The value that a text holds, or None: fences and talk around it, comments, trailing commas, single quotes and missing ends are mended."""
    if not text or not text.strip():
        return None
    t = re.sub(r"(?s)<think>.*?</think>", "", text)
    if m := re.search(r"(?s)```(?:\w+)?\s*(.*?)(?:```|\Z)", t):
        t = m[1]
    start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    for candidate in (t.strip(), t[start:] if start >= 0 else ""):
        try:
            return json.loads(candidate)
        except ValueError:
            pass
    if start < 0:
        return None
    out, stack, quote, k = [], [], "", start
    while k < len(t):
        c = t[k]
        if quote:
            if c == "\\" and k + 1 < len(t):
                out.append("'" if t[k + 1] == "'" else t[k : k + 2])
                k += 2
                continue
            if c == quote:
                out.append('"')
                quote = ""
            else:
                out.append({'"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c))
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            if not stack or stack[-1] != c:
                return None
            stack.pop()
            out.append(c)
            if not stack:
                break
        else:
            out.append(c)
        k += 1
    if quote:
        out.append('"')
    mended = "".join(out) + "".join(reversed(stack))
    mended = re.sub(r",\s*([}\]])", r"\1", mended)
    mended = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", mended)))
    mended = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', mended)
    try:
        return json.loads(mended)
    except ValueError:
        return None


def _objects(value: Any, keys: tuple[str, ...]) -> list | None:
    return value if isinstance(value, list) and all(isinstance(x, dict) and all(k in x for k in keys) for x in value) else None


def _nodes(value: Any) -> list | None:
    if _objects(value, ("id", "proposition")) is None:
        return None
    return [{"datetime": None, "subgraph_type": None, **x, "caused": x.get("caused") or [], "caused_by": x.get("caused_by") or []} for x in value]


def _category(value: Any) -> dict:
    value = value[-1] if isinstance(value, list) and value else value
    ok = isinstance(value, dict) and isinstance(value.get("category"), str)
    return {"category": value["category"], "is_personal": bool(value.get("is_personal"))} if ok else {"category": "", "is_personal": False}


def _with(value: Any, *keys: str) -> dict | None:
    return value if isinstance(value, dict) and all(k in value for k in keys) else None


def _supports(value: Any) -> dict | None:
    ok = _with(value, "supports", "confidence")
    return ok if ok and isinstance(ok["confidence"], int | float) else None


#: Contract by name: the Spark type of a parsed answer, and the check that gives it or None.
CONTRACTS: dict[str, tuple[str, Any]] = {
    "exchanges": ("array<struct<question: string, answer: string>>", lambda v: _objects(v, ("question", "answer"))),
    "described": ("array<struct<description: string, label: string>>", lambda v: _objects(v, ("description", "label"))),
    "links": ("array<struct<source: string, target: string>>", lambda v: _objects(v, ("source", "target"))),
    "category": ("struct<category: string, is_personal: boolean>", _category),
    "strings": ("array<string>", lambda v: v if isinstance(v, list) and all(isinstance(x, str) for x in v) else None),
    "judgement": ("struct<winner: string, relevant_items_per_list: map<string, bigint>>", lambda v: _with(v, "winner", "relevant_items_per_list")),
    "support": ("struct<supports: boolean, confidence: double>", _supports),
    "nodes": (f"array<{NODE_TYPE}>", _nodes),
    "new_links": ("array<struct<id: string, caused_by: array<string>, caused: array<string>>>", lambda v: [{"caused": [], "caused_by": [], **x} for x in v] if _objects(v, ("id",)) is not None else None),
    "sentiment": ("double", lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else float(v["sentiment"]) if isinstance(v, dict) and isinstance(v.get("sentiment"), int | float) else None),
    "proposition": ("string", lambda v: v["proposition"] if isinstance(v, dict) and isinstance(v.get("proposition"), str) else None),
    "hypothesis": ("string", lambda v: v["hypothesis"] if isinstance(v, dict) and isinstance(v.get("hypothesis"), str) else None),
    "claims_by_user": ("map<string, array<string>>", lambda v: v if isinstance(v, dict) and len(v) >= 2 and all(isinstance(x, list) for x in v.values()) else None),
    "day_decision": ("struct<decision: string, chunks: array<struct<start_time: string, end_time: string>>>", lambda v: {"chunks": [], **v} if isinstance(v, dict) and v.get("decision") in ("SPLIT", "NO_SPLIT", "SKIP") else None),
    "split": ("struct<decision: string, sentiment: double>", lambda v: {"sentiment": None, **v} if isinstance(v, dict) and v.get("decision") in ("SPLIT", "NO_SPLIT") else None),
    "verdict": ("struct<decision: string, explanation: string, new_hypothesis: string>", lambda v: {"explanation": None, "new_hypothesis": None, **v} if isinstance(v, dict) and v.get("decision") in ("accept", "refine", "reject") else None),
}


def parse(text: str | None, contract: str) -> Any:
    try:
        return CONTRACTS[contract][1](repair(text))
    except (TypeError, ValueError, KeyError):
        return None


def parse_strict(text: str, contract: str) -> Any:
    """As parse, for callers that must know of an answer that breaks the contract."""
    if (value := parse(text, contract)) is None:
        raise ValueError(f"not a {contract}: {text[:200]}")
    return value


def parse_column(text: Column, contract: str) -> Column:
    """Parsed answers. Well-formed JSON would not need Python; answers of a model do, in Arrow batches."""
    kind = CONTRACTS[contract][0]

    @F.pandas_udf("string")
    def mended(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if (v := parse(t, contract)) is None else json.dumps(v if kind.startswith(("array", "struct", "map")) else {"v": v}))

    out = mended(text)
    return F.from_json(out, kind) if kind.startswith(("array", "struct", "map")) else F.from_json(out, f"struct<v: {kind}>")["v"]
