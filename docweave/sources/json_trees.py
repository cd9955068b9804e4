"""Trees given as JSON, as adjacency rows."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

from pyspark.sql import DataFrame

from docweave.sources.markdown import _rows


def _parsed(text: str | None) -> object:
    """The value of a JSON text of any depth; None if it is none."""
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None
    except RecursionError:  # nested too deeply for the library
        try:
            return _deep(text)
        except (ValueError, IndexError):
            return None


_PLAIN = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_BLANK = re.compile(r"[ \t\n\r]*")


def _deep(text: str) -> object:
    """JSON by a stack of open values instead of recursion."""
    at = _BLANK.match(text, 0).end()
    stack: list[list | dict] = []
    keys: list[str | None] = []
    while True:
        c, closed = text[at], False
        if c in "[{":
            value: object = [] if c == "[" else {}
            at = _BLANK.match(text, at + 1).end()
            if text[at] == ("]" if c == "[" else "}"):
                at, closed = at + 1, True
            else:
                stack.append(value)
                keys.append(None)
        elif c == '"':
            value, at = scanstring(text, at + 1)
            closed = True
        else:
            plain = _PLAIN.match(text, at)
            if not plain:
                raise ValueError("no value")
            value, at, closed = json.loads(plain.group()), plain.end(), True
        while closed:  # put the value into what is open, and close that too if it ends here
            at = _BLANK.match(text, at).end()
            if not stack:
                if at < len(text):
                    raise ValueError("more than one value")
                return value
            if isinstance(stack[-1], list):
                stack[-1].append(value)
            else:
                stack[-1][keys[-1]] = value
            mark, end = text[at], "]" if isinstance(stack[-1], list) else "}"
            if mark not in ("," + end):
                raise ValueError("no comma")
            at = _BLANK.match(text, at + 1).end()
            if mark == ",":
                closed = False
            else:
                value = stack.pop()
                keys.pop()
        if stack and isinstance(stack[-1], dict):
            if text[at] != '"':
                raise ValueError("no key")
            keys[-1], at = scanstring(text, at + 1)
            at = _BLANK.match(text, at).end()
            if text[at] != ":":
                raise ValueError("no colon")
            at = _BLANK.match(text, at + 1).end()


def parse_tree(text: str | None) -> list[tuple[int, int | None, int, int, str]]:
    """(number, parent's number, depth, place, title) of the nodes of a tree.

    A node is an object with ``title`` or ``root`` and ``children`` or
    ``nodes``; other keys are dropped.  What is no object, and a node without a
    title, is ``Untitled``.  Text that is no JSON yields no node.
    """
    tree = _parsed(text)
    if tree is None:
        return []
    out: list[tuple[int, int | None, int, int, str]] = []
    todo = [(tree, None, 0, 0)]
    while todo:
        node, parent, depth, place = todo.pop()
        fields = node if isinstance(node, dict) else {}
        title = fields.get("title") or fields.get("root")
        below = fields.get("children") or fields.get("nodes") or []
        number = len(out)
        out.append((number, parent, depth, place, title if isinstance(title, str) and title.strip() else "Untitled"))
        todo += [(child, number, depth + 1, i) for i, child in reversed(list(enumerate(below if isinstance(below, list) else [])))]
    return out


def parse_picks(text: str | None, most: int | None = 5) -> list[str]:
    """The first ids of a JSON list; none if the text is no list."""
    picks = _parsed(text)
    return [p for p in picks if isinstance(p, str)][:most] if isinstance(picks, list) else []


def tree_nodes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Nodes of every JSON tree."""
    rows = _rows(documents, key, text, "node_no int, parent_no double, depth int, sibling_idx int, title string", lambda k, t: parse_tree(t))
    return rows.selectExpr(f"`{key}`", "node_no", "CAST(parent_no AS int) AS parent_no", "depth", "sibling_idx", "title")
