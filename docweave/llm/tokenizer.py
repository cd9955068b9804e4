"""Byte-level BPE encoding of whole corpora.

The vocabulary is compiled into an Aho-Corasick automaton over bytes that are
mapped one to one to Latin-1 characters.  One pass of it over a pre-token finds
the entries that match at each position; the longest is taken, and the next
shorter match whenever an entry can not stand beside its left neighbour.  "Can stand
beside" is decided by replaying the merges across the seam once per pair of
tokens and memoised, so the work per pre-token is linear in its length and the
result is exactly that of applying the merges in rank order.

Texts are cut before every space that precedes a visible character.  No
pre-token of the tokenizer's pattern crosses such a cut, so each piece can be
looked up in a cache of encoded pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.session import spread

#: Where the public vocabulary files lie; a parameter of every operator here.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern of the 50k byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Places of a pre-token whose matches are looked up at once.
WINDOW = 512
#: Encoded pieces and token pairs remembered by one Python worker.
CACHE_ENTRIES = 250_000
PAIR_ENTRIES = 300_000


class ByteBpe:
    """Exact byte-level BPE by longest match and back-off."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(PRETOKEN)
        self.ranks = ranks
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, rank in ranks.items():
            self.trie.add_word(piece.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.length = {rank: len(piece) for piece, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.halves:
            raw = self.bytes_of[token]
            if len(raw) == 1:
                self.halves[token] = None
            else:
                parts = self._replay([self.ranks[raw[i : i + 1]] for i in range(len(raw))], stop_at=2)
                self.halves[token] = (parts[0], parts[1])
        return self.halves[token]

    def _replay(self, tokens: list[int], stop_at: int = 1) -> list[int]:
        """Merge by rank until nothing merges or ``stop_at`` tokens are left."""
        tokens = list(tokens)
        while len(tokens) > stop_at:
            best, where = None, -1
            for i in range(len(tokens) - 1):
                rank = self.ranks.get(self.bytes_of[tokens[i]] + self.bytes_of[tokens[i + 1]])
                if rank is not None and (best is None or rank < best):
                    best, where = rank, i
            if best is None:
                break
            tokens[where : where + 2] = [best]
        return tokens

    def compatible(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens keeps the seam between them.

        Walking both merge trees from the top, the seam is lost if some pair of
        an ending part of ``left`` and a starting part of ``right`` merges
        before the next larger part on either side has been formed.
        """
        known = self.joined.get((left, right))
        if known is None:
            if len(self.joined) > PAIR_ENTRIES:
                self.joined.clear()
            known = self.joined[(left, right)] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        before_left, before_right = float("inf"), float("inf")
        # before_*: rank of the merge that swallows the current part on that side.
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            # On a tie of ranks the leftmost merge runs first, which is the one inside the left token.
            if merged is not None and merged < before_left and merged <= before_right:
                return False
            a, b = self._parts(left), self._parts(right)
            if a is None and b is None:
                return True
            # Undo the later of the two merges.
            if b is None or (a is not None and left > right):
                before_left, left = left, a[1]
            elif a is None or right > left:
                before_right, right = right, b[0]
            else:
                before_right, right = right, b[0]

    def _matches(self, text: str, start: int) -> list[list[int]]:
        """Entries that begin at each place from ``start``, shortest first, from one pass of the automaton."""
        end = min(len(text), start + WINDOW)
        found: list[list[int]] = [[] for _ in range(end - start)]
        for last, rank in self.trie.iter(text, start, min(len(text), end + self.longest)):
            first = last + 1 - self.length[rank] - start
            if 0 <= first < len(found):
                found[first].append(rank)
        return found

    def encode_pretoken(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        text, n = raw.decode("latin-1"), len(raw)
        begin, found = 0, self._matches(text, 0)
        tokens: list[int] = []
        tried: list[int] = []  # of each token, how many entries at its place are shorter
        dead = bytearray(n + 1)  # places from which no completion exists for the given tokens before
        at, left = 0, len(found[0])
        while at < n:
            if not begin <= at < begin + len(found):
                begin, found = at, self._matches(text, at)
            here = found[at - begin]
            if left < 0:
                left = len(here)
            while left:
                left -= 1
                token = here[left]
                if not dead[at + self.length[token]] and (not tokens or self.compatible(tokens[-1], token)):
                    tokens.append(token)
                    tried.append(left)
                    at, left = at + self.length[token], -1
                    break
            else:  # the next shorter match of the token before
                dead[at] = 1
                left = tried.pop()
                at -= self.length[tokens.pop()]
        return tokens

    def piece(self, text: str) -> bytes:
        """Ids of a text as packed int32."""
        out: list[int] = []
        for word in self.pattern.findall(text):
            out += self.encode_pretoken(word.encode("utf-8", "surrogatepass"))
        return np.asarray(out, dtype=np.int32).tobytes()

    def packed(self, text: str) -> bytes:
        """As :meth:`piece`, by cached pieces cut before spaces."""
        pieces = self.pieces
        words = text.split(" ")
        # A piece that is empty or starts with white space belongs to the white space before it.
        if "" in words or any(w[0].isspace() for w in words):
            words = _regrouped(words)
        else:
            first = words[0]
            words = [" " + w for w in words]
            words[0] = first
        try:
            return b"".join([pieces[w] for w in words])
        except KeyError:
            pass
        if len(pieces) > CACHE_ENTRIES:
            pieces.clear()
        out = []
        for w in words:
            ids = pieces.get(w)
            if ids is None:
                ids = self.piece(w)
                if len(w) <= 64:
                    pieces[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist() if text else []


def _regrouped(words: list[str]) -> list[str]:
    out: list[str] = []
    for i, w in enumerate(words):
        if i and (w == "" or w[0].isspace() or not out):
            out[-1] += " " + w
        else:
            out.append(" " + w if i else w)
    return out


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_VOCABULARY) -> ByteBpe:
    """The encoder of one Python worker; loaded once and shared by its tasks."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}")
    return ByteBpe(path)


def _strings(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    return column.to_pylist()


def encode_corpus(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY, out_column: str = "ids"
) -> DataFrame:
    """Ids of every text, one row for each input row.

    Null and empty texts get an empty list, so no row is lost; repeated rows
    stay repeated; other columns are not read.  Strings of special tokens are
    ordinary text.  The step is a map over the scan: nothing is shuffled.
    """
    kind = frame.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField(out_column, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            packed = [bpe.packed(t) if t else b"" for t in _strings(batch.column(1))]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, out_column])

    return spread(frame.select(id_column, text_column)).mapInArrow(run, schema)


def count_tokens(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY, out_column: str = "n_tokens"
) -> DataFrame:
    """Number of ids of every text; 0 for null and empty texts."""
    kind = frame.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField(out_column, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            sizes = np.fromiter((len(bpe.packed(t)) >> 2 if t else 0 for t in _strings(batch.column(1))), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[id_column, out_column])

    return spread(frame.select(id_column, text_column)).mapInArrow(run, schema)
