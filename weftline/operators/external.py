"""Calls out of the engine, in batches, with the client injected: completions, embeddings, agents.

Clients are objects with complete(messages) -> Answer, or embed(texts) -> list of vectors; tests use the deterministic ones here.
"""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as CallTimeout
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tolerant_json import parse
from ..sources.tables import cut


@dataclass
class Answer:
    text: str
    tokens_in: int = 0
    tokens_out: int = 0


class RetryLater(Exception):
    """The service asks callers to slow down, or fails for the moment (429 and 5xx)."""


class CallFailed(Exception):
    """The service refuses this call for good."""


#: What costs a call its answer; any other error is a mistake in the program and is raised.
FAILURES = (RetryLater, CallFailed, CallTimeout, ConnectionError, TimeoutError)


class Backoff:
    """One pause for all callers of a process: whoever is told to slow down makes everyone wait, longer each time in a row."""

    def __init__(self, pause: float = 1.0, growth: float = 2.0, most: float = 60.0) -> None:
        self.pause, self.growth, self.most = pause, growth, most
        self.lock, self.until, self.row = threading.Lock(), 0.0, 0

    def __reduce__(self):
        return Backoff, (self.pause, self.growth, self.most)

    def wait(self) -> None:
        while (left := self.until - time.monotonic()) > 0:
            time.sleep(left)

    def slow(self) -> None:
        with self.lock:
            if time.monotonic() >= self.until:  # calls that were under way fail together, and count once
                self.until = time.monotonic() + min(self.most, self.pause * self.growth**self.row)
                self.row += 1

    def fine(self) -> None:
        self.row = 0

    def call(self, f: Callable, *args, tries: int = 3, timeout: float | None = None):
        """f(*args), tried anew after RetryLater; raises what the last try raises, and CallTimeout for a call that takes too long."""
        for left in range(tries - 1, -1, -1):
            self.wait()
            try:
                got = within(f, args, timeout)
            except RetryLater:
                self.slow()
                if not left:
                    raise
            else:
                self.fine()
                return got
        raise CallFailed("no tries")


def within(f: Callable, args: tuple, timeout: float | None):
    """f(*args); CallTimeout after `timeout` seconds, and the call is left to itself."""
    if timeout is None:
        return f(*args)
    box: list = []
    done = threading.Event()

    def run() -> None:
        try:
            box.append((f(*args), None))
        except BaseException as e:  # noqa: BLE001  raised again in the caller's thread
            box.append((None, e))
        done.set()

    threading.Thread(target=run, daemon=True).start()
    if not done.wait(timeout):
        raise CallTimeout(f"no answer in {timeout} s")
    got, error = box[0]
    if error is not None:
        raise error
    return got


class DeterministicLLM:
    """Answers through a function of the messages, or by a digest of them."""

    def __init__(self, answer: Callable[[list[dict]], str] | None = None) -> None:
        self.answer = answer

    def complete(self, messages: list[dict]) -> Answer:
        text = self.answer(messages) if self.answer else hashlib.md5(json.dumps(messages).encode()).hexdigest()
        return Answer(text, sum(len(m["content"].split()) for m in messages), len(text.split()))


class DeterministicEmbedder:
    """Unit vectors seeded by the text."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")).standard_normal(self.size)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


def run_sequence(client, prompts: Sequence[str | Callable[[str], str]], tries: int = 3, backoff: Backoff | None = None, timeout: float | None = None) -> tuple[list[str], int, int, float]:
    """Answers of a chain of prompts in one conversation ([] if any fails), tokens in and out, seconds. A callable prompt gets the answer before it."""
    messages, answers, used, began = [], [], [0, 0], time.monotonic()
    backoff = backoff or Backoff(0.0)
    for prompt in prompts:
        messages.append({"role": "user", "content": prompt(answers[-1]) if callable(prompt) else prompt})
        try:
            got = backoff.call(client.complete, list(messages), tries=tries, timeout=timeout)
        except FAILURES:  # a failed call costs its row, not the batch
            return [], used[0], used[1], time.monotonic() - began
        messages.append({"role": "assistant", "content": got.text})
        answers.append(got.text)
        used[0] += got.tokens_in
        used[1] += got.tokens_out
    return answers, used[0], used[1], time.monotonic() - began


def complete(df: DataFrame, client, key: str, prompts: str, tries: int = 3, threads: int = 8, pause: float = 1.0, timeout: float | None = 300.0) -> DataFrame:
    """(key, answers, tokens_in, tokens_out, seconds) of df(key, prompts array<string>), as a table: all answers of a row's prompts, or none of them.

    The table is written here, so however often it is used, each prompt is sent once. Calls of a process share one back-off.
    """
    kind = dict(df.dtypes)[key]
    backoff = Backoff(pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(lambda p: run_sequence(client, [] if p is None else list(p), tries, backoff, timeout), pdf["p"]))
                yield pd.DataFrame({"k": pdf["k"], "answers": [g[0] for g in got], "tokens_in": [g[1] for g in got], "tokens_out": [g[2] for g in got], "seconds": [g[3] for g in got]})

    out = df.select(F.col(key).alias("k"), F.col(prompts).alias("p")).mapInPandas(run, f"k {kind}, answers array<string>, tokens_in long, tokens_out long, seconds double")
    return cut(out.withColumnRenamed("k", key), "answers")


def answer_column(df: DataFrame, client, key: str, prompt: Column, contract: str, name: str, which: int = -1) -> DataFrame:
    """df with a parsed answer to each row's prompt; null where a call fails or an answer breaks its contract."""
    from ..functions.tolerant_json import parse_column

    asked = complete(df.select(key, F.array(prompt).alias("_p")), client, key, "_p")
    parsed = asked.select(key, parse_column(F.try_element_at("answers", F.lit(which)), contract).alias(name))
    return df.join(parsed, key, "left")


def embed(df: DataFrame, client, text: str, name: str = "embedding", batch: int = 64, tries: int = 3, threads: int = 8, pause: float = 1.0, timeout: float | None = 300.0) -> DataFrame:
    """df with an embedding of each text, as a table; null for null texts and for batches that fail every try.

    The first batch goes alone, so that a service that starts on demand is awake before the others go at once.
    """
    schema = df.withColumn(name, F.lit(None).cast("array<double>")).schema
    backoff = Backoff(pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(texts: list[str]) -> list[list[float] | None]:
            try:
                return list(backoff.call(client.embed, texts, tries=tries, timeout=timeout))
            except FAILURES:
                return [None] * len(texts)

        warm = False
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                known = [k for k, t in enumerate(pdf[text]) if isinstance(t, str)]
                parts = [known[at : at + batch] for at in range(0, len(known), batch)]
                texts = [[pdf[text].iloc[k] for k in part] for part in parts]
                got = [] if warm or not parts else [one(texts[0])]
                got += pool.map(one, texts[len(got) :])
                warm = warm or bool(parts)
                out: list[list[float] | None] = [None] * len(pdf)
                for part, vectors in zip(parts, got, strict=True):
                    for k, v in zip(part, vectors, strict=True):
                        out[k] = v
                yield pdf.assign(**{name: out})

    return cut(df.mapInPandas(run, schema), "embedded")


#: Model catalogue, fixed values: dollars a million tokens in and out, calls at once, seconds to wait, tokens of context. Models that run on own machines cost nothing a call.
MODELS = {
    "claude": {"in": 3.0, "out": 15.0, "parallel": 10, "timeout": 300, "context": 200_000},
    "deepseek_r1": {"in": 0.85, "out": 2.50, "parallel": 200, "timeout": 300, "context": 64_000},
    "deepseek_v3": {"in": 0.27, "out": 1.10, "parallel": 50, "timeout": 600, "context": 16_000},
    "gemini_flash": {"in": 0.01875 * 4.5, "out": 0.075 * 4.5, "parallel": 200, "timeout": 300, "context": 1_000_000},
    "gemini_pro": {"in": 1.25, "out": 5.0, "parallel": 200, "timeout": 300, "context": 1_000_000},
    "gemma27b": {"in": 0.27, "out": 0.27, "parallel": 200, "timeout": 300, "context": 8192},
    "gemma9b": {"in": 0.06, "out": 0.06, "parallel": 200, "timeout": 300, "context": 8192},
    "gpt-4o": {"in": 2.50, "out": 10.0, "parallel": 32, "timeout": 600, "context": 128_000},
    "gpt-4o-mini": {"in": 0.15, "out": 0.60, "parallel": 50, "timeout": 600, "context": 128_000},
    "llama405b": {"in": 5.33, "out": 16.0, "parallel": 60, "timeout": 3600, "context": 128_000},
    "llama70b": {"in": 0.23, "out": 0.40, "parallel": 200, "timeout": 300, "context": 128_000},
    "llama70b_nemotron": {"in": 0.35, "out": 0.40, "parallel": 200, "timeout": 300, "context": 128_000},
    "llama70b_quantized": {"in": 0.0, "out": 0.0, "parallel": 200, "timeout": 300, "context": 80 * 1024},
    "llama70b_turbo": {"in": 0.13, "out": 0.40, "parallel": 200, "timeout": 300, "context": 128_000},
    "llama8b": {"in": 0.03, "out": 0.05, "parallel": 200, "timeout": 300, "context": 128_000},
    "mistral22b": {"in": 0.0, "out": 0.0, "parallel": 200, "timeout": 300, "context": 32_000},
    "mistral_nemo": {"in": 0.0, "out": 0.0, "parallel": 200, "timeout": 300, "context": 128_000},
    "o1-mini": {"in": 3.0, "out": 12.0, "parallel": 100, "timeout": 600, "context": 128_000},
    "qwen32b": {"in": 0.0, "out": 0.0, "parallel": 200, "timeout": 300, "context": 32_000},
    "embedder": {"in": 0.01, "out": 0.0, "parallel": 50, "timeout": 300, "context": 32_000},
}
MODELS |= {"small-hosted": MODELS["llama70b"], "large": MODELS["gpt-4o"], "reasoning": MODELS["deepseek_r1"]}


def cost(tokens_in: Column, tokens_out: Column, model: str) -> Column:
    """Dollars of calls, by the catalogue."""
    return (tokens_in * F.lit(MODELS[model]["in"]) + tokens_out * F.lit(MODELS[model]["out"])) / F.lit(1e6)


def usage(calls: DataFrame, model: str) -> DataFrame:
    """One row: sequences, failed ones, dollars, mean seconds and tokens."""
    dollars = cost(F.col("tokens_in"), F.col("tokens_out"), model)
    return calls.agg(F.count("*").alias("n"), F.count_if(F.size("answers") == 0).alias("failed"), F.sum(dollars).alias("dollars"), F.avg("seconds").alias("mean_s"), F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("mean_tokens"))


def perplexity(logprobs: Column) -> Column:
    return F.exp(-F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs))


@dataclass
class Trace:
    role: str
    content: str
    reasoning_content: str | None = None
    cost: float = 0.0
    token_count: int = 0
    timestamp: float = field(default_factory=time.time)


TRACE_SCHEMA = "role string, content string, reasoning_content string, cost double, token_count long, timestamp double"


def run_agent(client, system: str, task: str, tools: dict[str, Callable[..., object]], most: int = 12) -> tuple[dict | None, list[Trace]]:
    """(result, traces): a loop in which the model answers with {"actions": [{"name", "args"}]} or {"result": ...}; actions of one name overwrite each other's answer."""
    messages = [{"role": "system", "content": system}, {"role": "user", "content": task}]
    traces = [Trace(m["role"], m["content"]) for m in messages]
    for _ in range(most):
        got = client.complete(messages)
        from ..functions.tolerant_json import repair

        value = repair(got.text)
        messages.append({"role": "assistant", "content": got.text})
        traces.append(Trace("assistant", got.text, token_count=got.tokens_in + got.tokens_out))
        if isinstance(value, dict) and "result" in value:
            return value["result"], traces
        actions = value.get("actions") if isinstance(value, dict) else None
        if isinstance(actions, list) and all(isinstance(a, dict) and "name" in a for a in actions) and actions:
            with ThreadPoolExecutor(len(actions)) as pool:
                done = list(pool.map(lambda a: (a["name"], tools[a["name"]](**a.get("args", {})) if a["name"] in tools else "unknown action"), actions))
            reply = json.dumps(dict(done), default=str)
        else:
            reply = "Answer with JSON that holds actions or a result."
        messages.append({"role": "user", "content": reply})
        traces.append(Trace("user", reply))
    return None, traces


def orchestrate(client, system: str, task: str, agents: dict[str, tuple[object, str, dict[str, Callable[..., object]]]], most: int = 12) -> tuple[dict | None, list[Trace], list[dict]]:
    """(result, traces, suggestions): an agent whose tools are other agents, each a client, a system prompt and tools of its own, and a tool that only notes which questions may follow.

    Agents that are asked in one turn run at once; their traces follow the orchestrator's in the order of their names.
    """
    seen: dict[str, list[Trace]] = {}
    suggestions: list[dict] = []

    def ask(name: str) -> Callable[..., object]:
        def run(query: str) -> object:
            value, traces = run_agent(agents[name][0], agents[name][1], query, agents[name][2], most)
            seen.setdefault(name, []).extend(traces)
            return value

        return run

    def suggest(horizontal: Sequence[str] = (), vertical: Sequence[str] = ()) -> str:
        suggestions.append({"horizontal": list(horizontal), "vertical": list(vertical)})
        return "noted"

    result, traces = run_agent(client, system, task, {**{name: ask(name) for name in agents}, "suggestNextQuestions": suggest}, most)
    return result, traces + [t for name in sorted(seen) for t in seen[name]], suggestions


def with_retries(step: Callable[[], object], retries: int = 3, delay: float = 30.0, growth: float = 2.0, jitter: Callable[[], float] | None = None, sleep: Callable[[float], None] = time.sleep) -> object:
    """step(), run anew after an error up to `retries` times; waits grow by `growth` and are cut at random, so that steps which failed together don't return together.

    This is for whole steps of a job on machines that can go at any time; tasks inside a step are retried by Spark (spark.task.maxFailures).
    """
    draw = jitter or random.random
    for k in range(retries + 1):
        try:
            return step()
        except Exception:
            if k == retries:
                raise
            sleep(delay * growth**k * draw())
    raise AssertionError("unreachable")


def validate_hypothesis(client, hypothesis: str, tools: dict[str, Callable[..., object]], most: int = 3) -> tuple[list[dict], list[Trace]]:
    """(results, traces): verdicts on a hypothesis, which is refined and judged again until it is accepted or rejected."""
    results, traces = [], []
    for _ in range(most):
        value, seen = run_agent(client, "Judge the hypothesis by the graph.", hypothesis, tools)
        traces += seen
        verdict = parse(json.dumps(value), "verdict") if value is not None else None
        if verdict is None:
            break
        results.append(verdict)
        if verdict["decision"] != "refine" or not verdict.get("new_hypothesis"):
            break
        hypothesis = verdict["new_hypothesis"]
    return results, traces


def substantiate(claims: pd.DataFrame, evidence: pd.DataFrame, judge: Callable[[str, list[str]], dict | None], k: int = 20, least: float = 0.7, confidence: float = 0.6, skip: int = 0) -> pd.DataFrame:
    """label, supports, confidence, evidence of claims(label, description, embedding), in order; supported claims above `confidence` become evidence for later ones.

    The order decides the outcome, so claims of one graph are folded one by one; run it inside applyInPandas for many graphs.
    """
    labels, texts = list(evidence["label"]), list(evidence["description"])
    vectors = [np.asarray(v, dtype=float) for v in evidence["embedding"]]
    out = []
    for label, text, v in zip(claims["label"], claims["description"], claims["embedding"], strict=True):
        sim = np.array([x @ np.asarray(v, dtype=float) for x in vectors])
        best = [i for i in np.argsort(-sim, kind="stable") if sim[i] >= least][skip : skip + k]
        got = judge(text, [texts[i] for i in best]) if best else {"supports": False, "confidence": 0.0}
        got = got or {"supports": None, "confidence": None}
        out.append((label, got["supports"], got["confidence"], [labels[i] for i in best] if best else ["No supporting evidence found"]))
        if got["supports"] and (got["confidence"] or 0) > confidence:
            labels.append(label)
            texts.append(text)
            vectors.append(np.asarray(v, dtype=float))
    return pd.DataFrame(out, columns=["label", "supports", "confidence", "evidence"])
