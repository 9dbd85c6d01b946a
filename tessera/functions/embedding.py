"""Embedders and rerankers.  The built-in ones need no model: they are stand-ins for wiring and make no claim of quality."""

from __future__ import annotations

import random
import re
import threading
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT_INTENT, INTENTS, RANKING_RULES, RULE_DECLARATIONS, RULE_PATHS, RULE_TESTS
from tessera.functions.columns import TEST_QUERY

_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    dim: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Signed feature hashing of words, unit length; a text without words is the zero vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for w in _WORD.findall((text or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0].tolist()


def token_batches(texts: Iterable[str], tokens: Callable[[str], int], limit: int = 100_000) -> Iterator[list[str]]:
    """Consecutive texts of at most `limit` tokens together; an oversized one alone."""
    held: list[str] = []
    total = 0
    for text in texts:
        n = tokens(text)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(text)
        total += n
    if held:
        yield held


RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
RETRY_WORDS = ("429", "connection", "overload", "rate limit", "reset", "temporar", "timed out", "timeout", "tokens per min", "unavailable")


def call_with_retry(call: Callable[[], object], attempts: int = 5, base_ms: int = 250, most_ms: int = 5000, jitter_ms: int = 250, sleep: Callable[[float], None] = time.sleep) -> object:
    """For clients of remote models: doubling waits on passing errors, half a minute where a token quota is used up."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            text = str(e).lower()
            if n == attempts or not (getattr(e, "status_code", None) in RETRY_STATUS or any(w in text for w in RETRY_WORDS)):
                raise
            quota = "tpm" in text or "tokens per min" in text
            sleep(30.0 if quota else (min(most_ms, base_ms * 2 ** (n - 1)) + random.uniform(0, jitter_ms)) / 1000)
    raise AssertionError("unreachable")


class RemoteEmbedder:
    """A client of a remote model with bounded concurrency, pacing and retries.

    call(texts, kind) returns a vector for each text; kind is "document" or "query".  At most
    `in_flight` calls of a process run at once and at most `per_minute` begin in any minute; a
    cluster has as many processes as tasks, so divide a shared quota by their number.
    """

    def __init__(self, call: Callable[[list[str], str], list[list[float]]], dim: int = 1024, in_flight: int = 8, per_minute: int = 1800, batch_tokens: int = 100_000, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.call, self.dim, self.in_flight, self.per_minute, self.batch_tokens, self.clock, self.sleep = call, dim, in_flight, per_minute, batch_tokens, clock, sleep

    def _paced(self, began: deque, lock: threading.Lock) -> None:
        """Wait for a place among the calls of the last minute."""
        while True:
            with lock:
                now = self.clock()
                while began and now - began[0] >= 60:
                    began.popleft()
                if len(began) < self.per_minute:
                    began.append(now)
                    return
                wait = 60 - (now - began[0])
            self.sleep(wait)

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        batches = list(token_batches(texts, lambda t: len(_WORD.findall(t)), self.batch_tokens))
        began, lock = deque(), threading.Lock()

        def one(batch: list[str]) -> list[list[float]]:
            def attempt() -> list[list[float]]:
                self._paced(began, lock)
                return self.call(batch, "document")

            return call_with_retry(attempt, sleep=self.sleep)

        with ThreadPoolExecutor(self.in_flight) as pool:  # results come in the order of the batches
            rows = [v for part in pool.map(one, batches) for v in part]
        return np.array(rows, np.float32).reshape(len(texts), self.dim)

    def embed_query(self, text: str) -> list[float]:
        return list(call_with_retry(lambda: self.call([text], "query"), sleep=self.sleep)[0])


def remote_reranker(call: Callable[[str, list[str]], list[float]], intent: str = DEFAULT_INTENT, in_flight: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A reranker for `plans.search`: call(instruction with the query, texts) returns a score for each text.

    One call for each query of an Arrow batch, with retries, `in_flight` at a time.
    """

    @F.pandas_udf("double")
    def scores(query: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=text.index)
        groups = [(q, rows.index) for q, rows in text.groupby(query, sort=False)]
        with ThreadPoolExecutor(in_flight) as pool:
            made = pool.map(lambda g: call_with_retry(lambda: call(rerank_prompt(g[0], intent), text[g[1]].fillna("").tolist())), groups)
            for (_, index), values in zip(groups, made):
                out[index] = values
        return out

    return lambda df: df.withColumn("score", scores("query", "chunk_text"))


def embed(df: DataFrame, embedder: Embedder, text_col: str, out_col: str = "embedding", batch_tokens: int = 100_000) -> DataFrame:
    """df with a vector of each text, in Arrow batches; null text gives null."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        given = texts[texts.notna()]
        made = [embedder.embed_documents(b) for b in token_batches(given.tolist(), lambda t: len(_WORD.findall(t)), batch_tokens)]
        rows = [v for block in made for v in block]
        return pd.Series(rows, index=given.index, dtype=object).reindex(texts.index).where(lambda s: s.notna(), None)

    return df.withColumn(out_col, vectors(F.col(text_col)))


def rerank_prompt(query: str, intent: str) -> str:
    """Instruction, rules and query, for rerankers that follow instructions."""
    rules = list(RANKING_RULES)
    if not re.search(TEST_QUERY.replace(r"[^\p{L}\p{M}\p{N}_]", r"\W"), query):
        rules.append(RULE_TESTS)
    if intent in ("architecture", "definition"):
        rules.append(RULE_DECLARATIONS)
    if intent in ("debug", "usage"):
        rules.append(RULE_PATHS)
    return "\n".join([INTENTS[intent], "Ranking rules:", *(f"- {r}" for r in rules), f"Query: {query}"])


def lexical_score(query_words: Column, text_words: Column) -> Column:
    """Share of the query's words that the text has, 0 to 1: the built-in reranker, a plain column."""
    return F.when(F.size(query_words) > 0, F.size(F.array_intersect(query_words, text_words)) / F.size(query_words)).otherwise(F.lit(0.0))
