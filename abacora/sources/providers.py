"""Batch providers for embeddings and text generation, with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .store import shared_folder

Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for a remote model: signed word hashes, normalised."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for w in (t or "").lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % size] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else np.eye(size)[0]).tolist())
    return out


def checked(vectors: list, count: int, size: int) -> list[list[float]]:
    """As many vectors as texts, each of the right size, finite and not zero, scaled to length 1."""
    if len(vectors) != count:
        raise ValueError("the provider answered with another number of vectors")
    out = []
    for v in vectors:
        if not isinstance(v, (list, tuple)) or len(v) != size or any(isinstance(x, (bool, str)) or not isinstance(x, (int, float)) for x in v):
            raise ValueError("not a vector of the expected size")
        a = np.asarray(v, float)
        n = np.linalg.norm(a)
        if not np.isfinite(a).all() or n == 0:
            raise ValueError("vectors must be finite and not zero")
        out.append((a / n).tolist())
    return out


def retried(provider, attempts: int = 3, wait: float = 1.0, sleep=None):
    """A provider whose failures are retried, each wait twice as long as the one before it; Exhausted is passed on."""
    def ask(texts):
        for n in range(attempts):
            try:
                return provider(texts)
            except Exhausted:
                raise
            except Exception:
                if n + 1 == attempts:
                    raise
                (sleep or time.sleep)(wait * 2**n)

    return ask


def embed(df: DataFrame, provider: Embed = hashed_embedding, size: int = 64, batch: int = 32, text: str = "text", attempts: int = 3) -> DataFrame:
    """Adds embedding, asking the provider for at most `batch` texts at a time, in order, up to `attempts` times."""
    provider = retried(provider, attempts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, found = f[text].tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                found += checked(provider(part), len(part), size)
            yield f.assign(embedding=found)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, embedding array<double>")


class Exhausted(RuntimeError):
    """A provider that has no credit left, or a task whose calls are used up."""


def limited(provider, calls: int, cooldown: float = 300.0, clock=None):
    """A provider with at most `calls` calls in a task; after it was Exhausted once, it is not asked again until
    `cooldown` seconds have gone by."""
    now, state = clock or time.monotonic, {"left": calls, "until": 0.0}

    def ask(texts):
        if now() < state["until"]:
            raise Exhausted("cooling down")
        if state["left"] <= 0:
            raise Exhausted("no calls left")
        state["left"] -= 1
        try:
            return provider(texts)
        except Exhausted:
            state["until"] = now() + cooldown
            raise

    return ask


class SharedLimit:
    """A budget of calls that all tasks of all executors share, and a rest they all take after one was Exhausted.

    Each call first claims a number below `calls` by creating a file of that name in a shared folder, which only one of any number
    of workers can do; so no more calls are made than were allowed, also where tasks are tried again, and a later job with the
    same folder goes on with what is left. reset() begins anew.
    """

    def __init__(self, provider, folder: str, calls: int, cooldown: float = 300.0, clock=None):
        """folder: a path that all workers see as a file system (budget_folder()); clock: seconds that all workers share."""
        self.provider, self.folder, self.calls, self.cooldown, self.clock = provider, folder, calls, cooldown, clock or time.time
        os.makedirs(folder, exist_ok=True)

    @property
    def used(self) -> int:
        return sum(name.isdigit() for name in os.listdir(self.folder))

    def _claim(self) -> None:
        for n in range(self.used, self.calls):  # numbers are taken in order; who finds one taken tries the next
            try:
                os.close(os.open(os.path.join(self.folder, str(n)), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return
            except FileExistsError:
                continue
        raise Exhausted("no calls left")

    def _resting(self) -> bool:
        try:
            with open(os.path.join(self.folder, "until")) as f:
                return self.clock() < float(f.read())
        except FileNotFoundError:
            return False

    def __call__(self, texts):
        if self._resting():
            raise Exhausted("cooling down")
        self._claim()
        try:
            return self.provider(texts)
        except Exhausted:
            own = os.path.join(self.folder, f"until-{uuid.uuid4().hex}")
            with open(own, "w") as f:
                f.write(repr(self.clock() + self.cooldown))
            os.replace(own, os.path.join(self.folder, "until"))  # whole at once, the last one counts
            raise

    def reset(self) -> None:
        for name in os.listdir(self.folder):
            os.remove(os.path.join(self.folder, name))


def budget_folder(spark: SparkSession, name: str) -> str:
    """A budget's folder in the shared folder, which must be a mounted file system: an object store has no exclusive creation."""
    root = shared_folder(spark)
    if urlparse(root).scheme not in ("", "file"):
        raise ValueError("a shared budget needs a mounted folder in spark.checkpoint.dir")
    return os.path.join(urlparse(root).path, f"budget-{name}")


def complete(df: DataFrame, provider: Callable[[list[str]], list[str]], prompt: str = "prompt", attempts: int = 3, wait: float = 1.0, valid: Callable[[str], bool] | None = None, sleep=None) -> DataFrame:
    """Adds completion; a batch is tried `attempts` times, each wait twice as long as the one before it, then its error
    is the row's. Answers that `valid` refuses are asked for again, and are errors after the last attempt."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = sleep or time.sleep
        for f in frames:
            prompts = f[prompt].tolist()
            said: list = [None] * len(f)
            errors: list = [None] * len(f)
            open_ = list(range(len(f)))
            for n in range(attempts):
                try:
                    found = provider([prompts[i] for i in open_])
                    if len(found) != len(open_):
                        raise ValueError("the provider answered with another number of texts")
                    for i, text in zip(open_, found):
                        ok = valid is None or valid(text)
                        said[i], errors[i] = (text, None) if ok else (None, "the answer has another form")
                    open_ = [i for i in open_ if errors[i]]
                except Exception as e:  # noqa: BLE001  a provider may fail in any way
                    for i in open_:
                        errors[i] = f"{type(e).__name__}: {e}"
                if not open_:
                    break
                if n + 1 < attempts:
                    rest(wait * 2**n)
            yield f.assign(completion=said, error=errors)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, completion string, error string")
