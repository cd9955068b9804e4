"""One consistent form for text that looks the same but differs in characters.

Three steps.  (1) Compatibility folding of single characters: wide, narrow,
ligature and sign forms become the ordinary ones, every space separator
becomes a plain space, ignorable characters vanish, accents get one encoding.
(2) Each token that holds a letter with twins in another script becomes a
lattice: one column per character, one state per twin.  (3) A Viterbi search
picks the path that scores best under character bigrams of the scripts, with a
price for every change of script inside a token.

The lattice of a token depends only on what it looks like, and so does the set
of scripts a text may use (Latin, and any script of which the text holds a
letter without a Latin twin).  Texts that look the same therefore come out
equal, and texts that look different come out different.

For classes and pairs this is put to use: the table is read once for the look
of each value and for the bigrams together, and the search then runs on one
text per class of looks that holds different strings.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import cut, spread

# Letters of other scripts beside the Latin letter of the same shape.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "Ϲ": "C", "ϲ": "c", "ϳ": "j", "Ϳ": "J",
}
# Ignorable characters that are not of category Cf.
IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
# Characters of category Cf that are visible.
VISIBLE_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
# Kinds of compatibility decomposition that keep the look.
SAME_LOOK = {"wide", "narrow", "compat", "font", "initial", "medial", "final", "isolated", "noBreak"}

LATIN, CYRIL, HELLENIC = 0, 1, 2
#: Price, as a log probability, of a change of script inside a token.
SWITCH = -12.0
#: Bonus for a token of twins only that takes the script of the token before it.
CONTEXT = 8.0
#: Encoded tokens remembered by one Python worker.
CACHE_ENTRIES = 200_000

WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f][^\W\d_]*)*")
_TWIN = str.maketrans(CYRILLIC | GREEK)
_CANDIDATES: dict[str, list[tuple[str, int]]] = {}
for _script, _letters in ((CYRIL, CYRILLIC), (HELLENIC, GREEK)):
    for _other, _latin in _letters.items():
        _CANDIDATES.setdefault(_latin, [(_latin, LATIN)]).append((_other, _script))
_FOREIGN = re.compile("[Ͱ-Ͽἀ-\u1fffЀ-ԯ]")
#: Field of the rows that hold the bigrams of the model.
MODEL = -1


def _script_of(letter: str) -> int | None:
    if "Ѐ" <= letter <= "ԯ":
        return CYRIL
    if "Ͱ" <= letter <= "Ͽ" or "ἀ" <= letter <= "\u1fff":
        return HELLENIC
    if letter.isascii() or "À" <= letter <= "ɏ" or "Ḁ" <= letter <= "ỿ":
        return LATIN if letter.isalpha() else None
    return None


@lru_cache(maxsize=1)
def _folding() -> dict[int, str | None]:
    """Character table of step 1, made from the Unicode data by rule."""
    table: dict[int, str | None] = {ord(c): None for c in IGNORABLE}
    table |= {c: None for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))}  # variation selectors
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Zs":
            table[code] = " "
        elif kind == "Cf":
            if c not in VISIBLE_FORMAT:
                table[code] = None
        elif kind not in ("Cn", "Co", "Cs") and code not in table and c not in CYRILLIC and c not in GREEK:
            how = unicodedata.decomposition(c)
            if how.startswith("<") and how[1 : how.index(">")] in SAME_LOOK:
                plain = unicodedata.normalize("NFKC", c)
                if not plain.startswith(" "):  # spacing accents stay as they are
                    table[code] = plain
    return table


@lru_cache(maxsize=1)
def _folded() -> re.Pattern:
    """Any character that step 1 changes by itself, or of the further planes, which are rare."""
    ranges: list[list[int]] = []
    for code in sorted(c for c in _folding() if c < 0x10000) + [0x10000]:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    ranges.append([0x10001, sys.maxunicode])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


def fold(text: str) -> str:
    """Step 1."""
    if text.isascii():
        return text
    if _folded().search(text):
        text = text.translate(_folding())
    # Removing a joiner can bring a base and its accent together, so composition comes last.
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def look(text: str) -> str:
    """What a text looks like: folded, twins as Latin letters.  Texts look the same if this is equal."""
    if text.isascii():
        return text
    text = fold(text)
    if not _FOREIGN.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TWIN))


class Normalizer:
    """Steps 1 to 3 under one bigram model."""

    def __init__(self, bigrams: dict[tuple[int, str, str], int]):
        totals: Counter = Counter()
        alphabet: dict[int, set[str]] = {LATIN: set(), CYRIL: set(), HELLENIC: set()}
        for (script, a, b), n in bigrams.items():
            totals[script, a] += n
            alphabet[script] |= {a, b}
        self.bigrams, self.totals = bigrams, totals
        self.size = {s: len(x) + 2 for s, x in alphabet.items()}
        self.cache: dict[tuple[str, frozenset, int | None], tuple[str, int | None]] = {}

    def _score(self, script: int | None, a: str, b: str) -> float:
        if script is None:
            return 0.0
        a, b = a.lower(), b.lower()
        return math.log((self.bigrams.get((script, a, b), 0) + 0.5) / (self.totals.get((script, a), 0) + 0.5 * self.size[script]))

    def _token(self, token: str, allowed: frozenset, context: int | None) -> str:
        """Best path through the lattice of a token given by its Latin twins (decomposed)."""
        # Column of states: (letter, script) -> (score, path).  The ends of the token count as letters.
        states: dict[tuple[str, int | None], tuple[float, str]] = {("^", None): (0.0, "")}
        for c in token:
            options = [x for x in _CANDIDATES.get(c, [(c, _script_of(c))]) if x[1] is None or x[1] in allowed]
            column: dict[tuple[str, int | None], tuple[float, str]] = {}
            for letter, script in options:
                if script is None:  # an accent or other mark keeps the states of its base
                    column = {state: (score, path + letter) for state, (score, path) in states.items()}
                    continue
                best = None
                for (before, last), (score, path) in states.items():
                    same = last is None or last == script
                    s = score + (0.0 if same else SWITCH) + self._score(script, before if same else "^", letter)
                    # Ties go to the smaller path; Latin letters sort first.
                    if best is None or (-s, path) < (-best[0], best[1]):
                        best = (s, path)
                column[letter, script] = (best[0], best[1] + letter)
            states = column
        return min((-(s + self._score(last, before, "$") + (CONTEXT if last == context else 0.0)), path) for (before, last), (s, path) in states.items())[1]

    def token(self, token: str, allowed: frozenset, context: int | None) -> tuple[str, int | None]:
        """The token's form, and the script that it lends to the tokens after it."""
        key = (token, allowed, context)
        known = self.cache.get(key)
        if known is None:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            looks = unicodedata.normalize("NFD", unicodedata.normalize("NFD", token).translate(_TWIN))
            anchors = {_script_of(c) for c in looks if c not in _CANDIDATES} - {None}
            lent = anchors.pop() if len(anchors) == 1 else context
            known = self.cache[key] = (unicodedata.normalize("NFC", self._token(looks, allowed, context)), lent)
        return known

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        text = fold(text)
        foreign = set(_FOREIGN.findall(text))
        if not foreign:
            return text
        bases = {unicodedata.normalize("NFD", c)[0] for c in foreign}
        allowed = frozenset({LATIN} | ({_script_of(c) for c in bases if c.translate(_TWIN) == c} - {None}))
        if len(allowed) == 1:  # every lattice has one path
            return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TWIN))
        context, out, at = None, [], 0
        for m in WORD.finditer(text):
            form, context = self.token(m.group(), allowed, context)
            out += [text[at : m.start()], form]
            at = m.end()
        out.append(text[at:])
        # Marks that did not compose with a foreign base may do so with the Latin one.
        return unicodedata.normalize("NFC", "".join(out))


def _bigrams(tokens: Counter) -> Counter:
    """Bigrams of the words in tokens that hold no white space."""
    words: Counter = Counter()
    for token, n in tokens.items():
        for word in WORD.findall(token):
            words[word] += n
    counts: Counter = Counter()
    for word, n in words.items():
        base = [c for c in unicodedata.normalize("NFD", word.lower()) if c.isalpha()]
        scripts = {_script_of(c) for c in base}
        if len(scripts) != 1 or None in scripts:
            continue
        (script,) = scripts
        # A token of twins only does not tell its script, unless it is plain ASCII.
        if script != LATIN and all(c in CYRILLIC or c in GREEK for c in base):
            continue
        for a, b in zip(["^", *base], [*base, "$"]):
            counts[script, a, b] += n
    return counts


def script_bigrams(frame: DataFrame, column: str) -> dict[tuple[int, str, str], int]:
    """Character bigrams of each script over all rows.

    Counted per batch in Python, summed by Spark.  The result has at most one
    entry per pair of letters of one script, whatever the size of the input,
    so it may go to the driver.
    """
    schema = "script int, a string, b string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(text.split())
            if len(words) > CACHE_ENTRIES:
                total += _bigrams(words)
                words.clear()
        total += _bigrams(words)
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]), pa.array([total[k] for k in keys], pa.int64())],
                names=["script", "a", "b", "n"],
            )

    rows = spread(frame.select(column)).mapInArrow(run, schema).groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r["script"], r["a"], r["b"]): r["n"] for r in rows}


def normalize_columns(frame: DataFrame, columns: list[str], bigrams: dict[tuple[int, str, str], int] | None = None) -> DataFrame:
    """Replace ``columns`` by their consistent form; all other columns stay.

    Nulls stay null, empty text stays empty, repeated rows stay repeated.
    ``bigrams`` defaults to those of the first of the columns.
    """
    model = script_bigrams(frame, columns[0]) if bigrams is None else bigrams
    places = [frame.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normalizer(model)
        for batch in batches:
            arrays = list(batch.columns)
            for i in places:
                arrays[i] = pa.array([normal(t) for t in arrays[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return spread(frame).mapInArrow(run, frame.schema)


def _readings(frame: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, id, a, b, tag, shown): what each value looks like and is, from one scan.

    ``a`` and ``b`` are 128 bits of the look, ``tag`` 64 bits of the string as
    it is, ``shown`` the look itself where it is another string.  Rows of the
    field MODEL hold the character bigrams of the last field instead: ``shown``
    the script and both letters, ``tag`` their number.
    """
    schema = T.StructType([
        T.StructField("field", T.IntegerType()), T.StructField("id", frame.schema[key].dataType), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("shown", T.StringType()),
    ])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        words: Counter = Counter()
        total: Counter = Counter()
        id_type = None
        for batch in batches:
            ids = batch.column(0)
            id_type = ids.type
            for i, _ in enumerate(fields):
                keep, first, second, tags, shown = [], [], [], [], []
                for at, text in enumerate(batch.column(i + 1).to_pylist()):
                    if text is None:
                        continue
                    if i == len(fields) - 1:
                        words.update(text.split())
                    seen = look(text)
                    digest = xxh3_128_intdigest(seen.encode("utf-8", "surrogatepass"))
                    keep.append(at)
                    first.append(signed(digest >> 64))
                    second.append(signed(digest & (1 << 64) - 1))
                    tags.append(signed(xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))))
                    shown.append(None if seen == text else seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(keep), pa.int32()), ids.take(pa.array(keep, pa.int64())), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(tags, pa.int64()), pa.array(shown, pa.string())], names=names,
                )
            if len(words) > CACHE_ENTRIES:
                total += _bigrams(words)
                words.clear()
        total += _bigrams(words)
        if total:
            none = pa.nulls(len(total), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([MODEL] * len(total), pa.int32()), pa.nulls(len(total), id_type), none, none, pa.array(list(total.values()), pa.int64()), pa.array([f"{k[0]}{k[1]}{k[2]}" for k in total])], names=names)

    return spread(frame.select(key, *fields)).mapInArrow(run, schema)


def _members(frame: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, form, tag, id) of all values in classes of the same look that hold different strings, each once.

    ``form`` is the consistent form of the class, from the lattice search.
    """
    frame = frame.where(F.col(key).isNotNull())
    # The texts are read once; what is kept is some 40 bytes a value, and the look where it differs.
    read = cut(_readings(frame, key, fields))
    counted = read.where(F.col("field") == MODEL).groupBy("shown").agg(F.sum("tag").alias("n")).collect()  # at most a row per pair of letters of a script
    model = {(int(r["shown"][0]), r["shown"][1], r["shown"][2]): r["n"] for r in counted}
    values = read.where(F.col("field") != MODEL)
    # A class with one string has one tag; partial aggregation shrinks a hot class before the shuffle.
    # Half of the look is enough to find candidates; the other half parts them below.
    mixed = values.groupBy("field", "a").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("field", "a")
    near = cut(values.drop("shown").join(mixed, ["field", "a"], "left_semi").distinct())
    parted = near.groupBy("field", "a", "b").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("field", "a", "b")
    # Of the strings of a class one at most is the look itself, so every class finds its look among the others.
    looks = values.where("shown is not null").groupBy("field", "a", "b").agg(F.first("shown").alias("shown"))
    classes = looks.join(parted, ["field", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normalizer(model)
        for batch in batches:
            forms = pa.array([normal(t) for t in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], forms], names=["field", "a", "b", "form"])

    formed = classes.select("field", "a", "b", "shown").mapInArrow(run, "field int, a long, b long, form string")
    named = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    # The form of a class may be long; its members carry 128 bits of it.
    short = formed.select("field", "a", "b", F.unhex(F.md5("form")).alias("form"))
    return near.join(short, ["field", "a", "b"]).select(named.alias("field"), "form", "tag", "id")


def lookalike_pairs(frame: DataFrame, key: str = "block_id", fields: tuple[str, ...] = ("text", "markdown")) -> DataFrame:
    """Pairs of rows with different ids whose values look the same but are not the same string.

    Result: ``<key>_a < <key>_b``, ``field``; each pair once.  Null values and
    null ids take part in no pair; repeated rows count once; an empty table
    gives an empty result.  Looks are compared by 128-bit fingerprints, strings
    of one look by 64 bits.

    Only classes with two or more different strings go on to the join, and the
    join runs along pairs of strings, not along all pairs of rows of a class:
    a class of exact copies, however large, makes no candidate at all.  All
    pairs of a class of n and m equal strings are n times m rows;
    :func:`lookalike_classes` says the same in n + m.
    """
    members = cut(_members(frame, key, list(fields)))
    kinds = members.select("field", "form", "tag").distinct()
    seams = kinds.join(kinds.withColumnRenamed("tag", "tag_b"), ["field", "form"]).where("tag < tag_b")
    left = members.withColumnRenamed("id", "id_l")
    right = members.select("field", "form", F.col("tag").alias("tag_b"), F.col("id").alias("id_r"))
    pairs = seams.join(left, ["field", "form", "tag"]).join(right, ["field", "form", "tag_b"]).where("id_l <> id_r")
    return pairs.select(F.least("id_l", "id_r").alias(f"{key}_a"), F.greatest("id_l", "id_r").alias(f"{key}_b"), "field").distinct()


def lookalike_classes(frame: DataFrame, key: str = "block_id", fields: tuple[str, ...] = ("text", "markdown")) -> DataFrame:
    """The classes behind :func:`lookalike_pairs`: one row per member, whatever the size of a class.

    Result: ``key``, ``field``, ``class_id`` (of the class's consistent form),
    ``string_id`` (of the member's string), ``links``: the number of rows of
    the class that hold another string.  A row delivered with two strings has
    two rows.  Counts are taken per string with a map-side combine.
    """
    members = cut(_members(frame, key, list(fields)))
    strings = members.groupBy("field", "form", "tag").agg(F.count(F.lit(1)).alias("_same"))
    totals = strings.groupBy("field", "form").agg(F.sum("_same").alias("_all"))
    counted = strings.join(totals, ["field", "form"]).withColumn("links", F.col("_all") - F.col("_same"))
    joined = members.join(counted.select("field", "form", "tag", "links"), ["field", "form", "tag"])
    return joined.select(F.col("id").alias(key), "field", F.lower(F.hex("form")).alias("class_id"), F.col("tag").alias("string_id"), "links")
