"""Table functions for SQL: ``SELECT t.doc_id, b.* FROM t, LATERAL markdown_blocks(t.text) b``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docweave.sources.json_trees import parse_tree
from docweave.sources.markdown import parse_blocks, parse_outline, parse_questions


class MarkdownBlocks:
    def eval(self, text: str) -> Iterator[tuple]:
        for i, b in enumerate(parse_blocks(text)):
            yield i, b.type, b.level, b.text, b.language, b.src, b.alt


class QuestionBlocks:
    def eval(self, text: str) -> Iterator[tuple]:
        for i, (path, q, a) in enumerate(parse_questions(text)):
            yield i, path, q, a


class OutlineNodes:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from parse_outline(text)


class TreeNodes:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from parse_tree(text)


_NODE = "node_no int, parent_no int, depth int, sibling_idx int, title string"
FUNCTIONS = {
    "markdown_blocks": (MarkdownBlocks, "pos int, type string, level int, text string, language string, src string, alt string"),
    "question_blocks": (QuestionBlocks, "pos int, heading_path array<string>, q string, a string"),
    "outline_nodes": (OutlineNodes, _NODE),
    "tree_nodes": (TreeNodes, _NODE),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, (cls, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=schema))
