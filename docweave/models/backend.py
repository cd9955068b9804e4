"""Model backends: what a language model would be asked, answered by rules.

A backend answers for one record at a time inside a Python worker; one
instance serves a worker.  The default extracts: it honours the constraints of
each request (known ids only, one node per block, at most five prerequisites)
but does not write like a language model.  A client of a real endpoint can be
plugged in by passing a factory.
"""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from docweave.sources.json_trees import parse_picks

_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{4,}")


class ModelBackend(Protocol):
    """One method per request; texts in, texts or plain values out."""

    def tags(self, markdown: str) -> list[str]: ...
    def questions(self, markdown: str, caption: str, kind: str) -> list[str]: ...
    def answer(self, question: str, markdown: str) -> str: ...
    def bullets(self, markdown: str) -> str: ...
    def reformat(self, markdown: str) -> str: ...
    def clean(self, markdown: str) -> str: ...
    def leaf_note(self, title: str, path: str, content: str) -> str: ...
    def branch_note(self, title: str, path: str, digest: str) -> str: ...
    def pick_prereqs(self, node_id: str, candidates: list[str]) -> list[str]: ...
    def merge(self, left: str, right: str) -> str: ...


def sentences(markdown: str) -> list[str]:
    """Sentences outside code, tables, headings and images."""
    text = re.sub(r"(?ms)^```.*?^```[ \t]*$", "", markdown)
    lines = [x for x in text.split("\n") if not x.lstrip().startswith(("#", "|", "!["))]
    return [s.strip() for s in _SENTENCE.split("\n".join(lines)) if s.strip()]


class ExtractiveBackend:
    """The deterministic default."""

    def tags(self, markdown: str) -> list[str]:
        counts: dict[str, int] = {}
        for w in _WORD.findall(markdown.lower()):
            counts[w] = counts.get(w, 0) + 1
        return sorted(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5])

    def questions(self, markdown: str, caption: str, kind: str) -> list[str]:
        about = (caption or "").strip().rstrip(".") or (sentences(markdown) or ["this part"])[0][:80].rstrip(".")
        form = {"code": "What does the code for “{}” do?", "table": "What does the table “{}” show?", "image": "What does the image “{}” show?"}.get(kind, "What is said about “{}”?")
        return [form.format(about)]

    def answer(self, question: str, markdown: str) -> str:
        return markdown.strip()

    def bullets(self, markdown: str) -> str:
        out = []
        for line in markdown.split("\n"):
            if line.startswith("#"):
                out.append(line)
            else:
                out += [f"- {s}" for s in sentences(line)]
        return "\n".join(out)

    def reformat(self, markdown: str) -> str:
        text = markdown.replace("\r\n", "\n").replace("\r", "\n")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)", "", text)).strip()

    def clean(self, markdown: str) -> str:
        kept, seen = [], set()
        for part in re.split(r"\n{2,}", markdown.strip()):
            if part.strip() and part.strip() not in seen:
                seen.add(part.strip())
                kept.append(part.strip())
        return "\n\n".join(kept)

    def leaf_note(self, title: str, path: str, content: str) -> str:
        said = sentences(content)
        summary = " ".join(said[:2]) or title
        parts = [f"# {title}", f"## Summary\n{summary}", f"## Context\n{path}"]
        for name, chosen in (("Key points", said[2:7]), ("Details", said[7:12]), ("Examples", [s for s in said if re.search(r"\d", s)][:3])):
            if chosen:
                parts.append(f"## {name}\n" + "\n".join(f"- {s}" for s in chosen))
        return "\n\n".join(parts)

    def branch_note(self, title: str, path: str, digest: str) -> str:
        return f"# {title}\n\n## Summary\n{path}\n\n## Overview\n{digest or title}"

    def merge(self, left: str, right: str) -> str:
        """Union of two JSON trees: equal titles (without case) of one parent are one node."""
        a, b = json.loads(left or "{}"), json.loads(right or "{}")
        todo = [(a, b)]
        while todo:
            into, more = todo.pop()
            known = {str(c.get("title", "")).strip().lower(): c for c in into.setdefault("children", [])}
            for child in more.get("children", []):
                same = known.get(str(child.get("title", "")).strip().lower())
                if same is None:
                    into["children"].append(child)
                    known[str(child.get("title", "")).strip().lower()] = child
                else:
                    todo.append((same, child))
        return json.dumps(a, ensure_ascii=False)

    def pick_prereqs(self, node_id: str, candidates: list[str]) -> list[str]:
        return [c for c in candidates if c != node_id][:5]


class Limiter:
    """A least delay between calls, shared by the threads of one worker; each caller reserves its own slot."""

    def __init__(self, delay: float):
        self.delay, self.free, self.lock = delay, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.delay <= 0:
            return
        with self.lock:
            now = time.monotonic()
            slot = max(now, self.free)
            self.free = slot + self.delay
        time.sleep(max(0.0, slot - now))


def call(fn: Callable[..., Any], *args: Any, attempts: int = 4, limiter: Limiter | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call with retries: waits 1, 2, 4, 8, 8, ... seconds and up to a quarter more; raises after the last; at least one call."""
    for attempt in range(1, max(1, attempts) + 1):
        try:
            if limiter:
                limiter.wait()
            return fn(*args)
        except Exception:
            if attempt >= max(1, attempts):
                raise
            sleep(min(2 ** (attempt - 1), 8) + random.random() * 0.25)
    raise AssertionError("unreachable")


def ask(
    frame: DataFrame, keys: list[str], inputs: list[str], method: str, out: str, out_type: str = "string", factory: Callable[[], ModelBackend] = ExtractiveBackend, attempts: int = 4, min_delay: float = 0.0, traced: bool = False
) -> DataFrame:
    """Ask the backend once per row: ``keys`` and the answer.

    Only keys and inputs reach Python.  Null texts are asked as empty texts;
    an answer that is not a text becomes JSON.  One client per worker.
    ``min_delay`` holds between any two calls of the whole run: as many tasks
    run at once, each waits so much longer.  If ``traced``, the inputs and the
    time of each call (``_started``, ``_seconds``, its retries and delays
    included) come along.
    """
    min_delay *= frame.sparkSession.sparkContext.defaultParallelism
    kept = [*keys, *[c for c in inputs if c not in keys]] if traced else keys
    schema = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in kept) + f", `{out}` {out_type}" + (", _started double, _seconds double" if traced else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, limiter = factory(), Limiter(min_delay)
        asked = getattr(backend, method)
        for pdf in frames:
            columns = [pdf[c] for c in inputs]
            answers, times = [], []
            for row in zip(*columns):
                began = time.time()
                value = call(asked, *map(_given, row), attempts=attempts, limiter=limiter)
                if out_type == "array<string>" and isinstance(value, str):  # a client that answers with the text of a list
                    value = parse_picks(value, None)
                times.append((began, time.time() - began))
                answers.append(value if out_type != "string" or isinstance(value, str) else json.dumps(value, ensure_ascii=False))
            yield pdf[kept].assign(**{out: answers}, **({"_started": [t[0] for t in times], "_seconds": [t[1] for t in times]} if traced else {}))

    return frame.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, schema)


def _given(x: Any) -> Any:
    """A cell as a plain value: arrays as lists, nulls as empty texts."""
    if hasattr(x, "tolist"):
        return x.tolist()
    return "" if x is None or x is pd.NA or x != x else x
