"""Prompts of model requests: a file given for a key, else the built-in text."""

from __future__ import annotations

import warnings
from pathlib import Path

#: What each request asks for; a client of a real endpoint puts the record below it.
BUILT_IN = {
    "tree": "Build a concept tree of two or three levels from the chunk. Return title and children, and three to ten tags.",
    "merge": "Merge both concept trees. Use given concepts only; put equal ones together.",
    "refine": "Tidy the tree: at most six siblings, depth three, no concept twice.",
    "map_content": "Put each block on exactly one node of the tree. Use known ids only.",
    "map_questions": "Put each question on exactly one node of the tree. Use known ids only.",
    "questions": "Write the questions that the chunk answers; one at least for each code, table and image block.",
    "answers": "Answer each question from the chunk alone. Keep code and tables as they are.",
    "bullets": "Rewrite the chunk as nested bullets in the same order.",
    "reformat": "Repair the layout of the chunk. Keep first and second level headings.",
    "clean": "Remove what does not carry content. Add nothing.",
    "leaf_note": "Write a note on the node in eight sections.",
    "branch_note": "Write a note on the node in five sections from the summaries of its children.",
    "prereqs": "Choose up to five prerequisites among the candidates: not the node itself, none of its children, no other ids.",
}


def prompt(key: str, overrides: dict[str, str] | None = None) -> str:
    """The prompt for ``key``; a missing override file gives a warning and the built-in text."""
    path = (overrides or {}).get(key)
    if path:
        file = Path(path)
        if file.is_file():
            return file.read_text(encoding="utf-8")
        warnings.warn(f"no prompt file {path} for {key}", stacklevel=2)
    if key not in BUILT_IN:
        raise KeyError(f"unknown prompt {key!r}; known: {', '.join(sorted(BUILT_IN))}")
    return BUILT_IN[key]
