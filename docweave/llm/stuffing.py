"""Pages made of repeated keywords, link lists, tags or goods lines.

Every text is read as a sequence of word classes: function words by kind,
content words by shape and by how many of them stand since the last function
word, numbers, links, tags, prices, and the punctuation between them.  A
trigram model of such sequences is trained on the sentences of the whole
corpus.  The perplexity of every stretch of text is held against that of the
sentences: a stretch is no prose if its bits lie further above (or below) the
mean of the sentences than chance allows for its length.  Only such a stretch
can be stuffing, and it is if an exact check finds links to other sites, tags,
goods, or words that come again and again.  A page is flagged if most of its
characters are stuffing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import spread

# Function words by kind, in the languages of the corpus.
FUNCTION_WORDS = {
    "det": {
        "en": "a an the this that these those each every some any no its their his her our my your all both several another",
        "de": "der die das den dem des ein eine einen einem einer eines dieser diese dieses jeder jede jedes kein keine keinen",
        "fr": "le la les un une des du ce cet cette ces chaque quelques leur leurs son sa ses tout tous toutes",
        "es": "el los las una unos unas este esta estos estas cada su sus todo todos algunas algunos",
        "ru": "этот эта это эти каждый каждая каждое весь вся все его её их",
    },
    "prep": {
        "en": "of in on at by for with from to into over under after before between during until without about through across along near per as",
        "de": "von im in am an auf für mit aus zu zum zur nach vor bei über unter zwischen während ohne durch bis um pro ins beim vom",
        "fr": "de à au aux en dans sur par pour avec sans sous entre après avant pendant chez vers près",
        "es": "del al por para con sin sobre bajo entre tras desde hasta según junto después antes durante",
        "ru": "в во на с со к ко по из от до у о об для без над под при через после между перед возле около",
    },
    "conj": {
        "en": "and or but if because when while then than so nor once whether although where what which who whose how why",
        "de": "und oder aber wenn weil dass als ob sondern denn während bevor nachdem wie was wer wo",
        "fr": "et ou mais si parce que quand lorsque donc car ni comme où qui quoi dont",
        "es": "y e o u pero si porque que cuando mientras sino aunque como donde quien",
        "ru": "и а но или если потому что когда чтобы как где кто чем зачем поэтому затем также",
    },
    "other": {
        "en": "i you he she it we they me him us them is are was were be been has have had do does did will would can could may might must shall should not n't isn't don't doesn't it's we've they'd wouldn't won't only also rarely instead exactly there here just more most very later",
        "de": "ich du er sie es wir ihr ist sind war waren wird werden hat haben kann können soll muss nicht nur auch hier später sich man",
        "fr": "je tu il elle nous vous ils elles on est sont était a ont peut doit ne pas plus aussi ici puis se y",
        "es": "yo tú él ella nosotros ellos es son era fue ha han puede debe no más también aquí se lo le les luego",
        "ru": "я ты он она оно мы вы они не ни бы был была было были есть будет можно нужно только уже здесь потом сначала позже",
    },
}

#: Content words are numbered from the last function word; the last number stands for all further ones.
PLACES = 6
LANGUAGES = ("en", "de", "fr", "es", "ru", "ja")
_FUNCTION_KINDS = (*FUNCTION_WORDS, "jparticle")
_CLASSES = "num url node tag price code comma semi end sep colon bracket bullet verb symbol break line".split()
_CONTENT = ("low", "cap", "upper", "cyrillic", "adjective", "jcontent")
FIRST_CONTENT = len(_FUNCTION_KINDS) + len(_CLASSES)
C = {name: i for i, name in enumerate((*_FUNCTION_KINDS, *_CLASSES))} | {name: FIRST_CONTENT + PLACES * i for i, name in enumerate(_CONTENT)}
N = FIRST_CONTENT + PLACES * len(_CONTENT)
# A function word of one language has a class of its own until the language of its text is known.
_SPOKEN = {(kind, language): N + len(FUNCTION_WORDS) * i + C[kind] for i, language in enumerate(LANGUAGES[:5]) for kind in FUNCTION_WORDS}
_SILENT = bytes(c if c < N else (c - N) % len(FUNCTION_WORDS) for c in range(256))
_VOTES = np.zeros((len(LANGUAGES), 256), dtype=np.int64)
for (_kind, _language), _code in _SPOKEN.items():
    _VOTES[LANGUAGES.index(_language), _code] = 1
_VOTES[LANGUAGES.index("ru"), [C["cyrillic"], C["adjective"], C["verb"]]] = 1
_VOTES[LANGUAGES.index("ja"), [C["jparticle"], C["jcontent"]]] = 1

#: Standard errors above the mean bits of a sentence from which a stretch is no prose, and below which it repeats itself.
HIGH_Z, LOW_Z = 2.5, -4.0
#: Standard errors from which a stretch beside one that is no prose is none either.
BESIDE_Z = 1.0
#: Classes in the shortest stretch that is judged by itself.
STRETCH = 8
#: Classes up to which a longer stretch makes the same deviation less likely.
LONGEST = 32
#: Classes of a language's sentences below which all languages lend it their mean.
LEAST_TRAINED = 2_000
#: Share of function words among the words of a sentence of the training set, and of different ones among its long words.
FUNCTION_SHARE, DIFFERENT = 0.12, 0.8
#: Non-prose of LEAST_WORDS words or more is made of keywords if its different words over words ** GROWTH, less the share of words that
#: stand in pairs said more than once, are RICHNESS at most; tables, which repeat their cells, at most TABLE_RICHNESS.
LEAST_WORDS, GROWTH, RICHNESS, TABLE_RICHNESS = 30, 0.6, 2.3, 0.0
#: Share of a text's characters from which the page is flagged.
FLAG_SHARE = 0.5

CACHE_ENTRIES = 300_000

# Marks that stand for a link to another site and for a link to a page of the same vault.
EXTERNAL, INTERNAL = "\ue000", "\ue001"

# Letters before an apostrophe that stand for a function word.
ELIDED = "ldnjscmt"
# Endings of Russian verbs in the third person and of adjectives.
VERB_ENDINGS = tuple("ет ёт ит ут ют ат ят тся".split())
ADJECTIVE_ENDINGS = tuple("ый ий ой ая яя ое ее ые ие ого его ому ему ых их ым им ую юю".split())
# Endings of host names that are links without a scheme.
HOST_ENDINGS = set("com org net info biz shop store online io co example invalid test site xyz de fr es ru jp uk".split())

_URL = re.compile(r"(?i)(?:https?://|ftp://|www\.)\S+")
_HOST = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*(?:/\S*)?")
_DOTTED = re.compile(r"[A-Za-z0-9-]\.[A-Za-z]")
_MARKDOWN_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*)\)")
_HTML = re.compile(r"<[/!a-zA-Z][^<>]*>")
_TARGET = re.compile(r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]*)")
_TAG_NAME = re.compile(r"</?([a-zA-Z0-9]+)")
# Elements that begin a new line.
_BREAKS = set("p br li ul ol h1 h2 h3 h4 h5 h6 div tr table body html td th".split())
_NUMBER = re.compile(r"^\d{1,4}[.)]\s+")
_ITEM = re.compile(r"^\d{1,2}[.)]$")
_CUE_TIME = re.compile(r"^\s*(?:\d+:)?\d+:\d+[.,]?\d*\s*-->.*$")
_PRICE = re.compile(r"^(?:[$€£¥₽]\d[\d.,]*|\d[\d.,]*[$€£¥₽円]|EUR|USD|GBP|RUB|руб\.?)$")
_CURRENCY = re.compile(r"(?:[$€£¥₽]\s?\d|\d\s?[$€£¥₽円]|\b(?:EUR|USD|GBP|RUB)\s?\d|\d\s?(?:EUR|USD|GBP|RUB|руб)\b)")
_TAG = re.compile(r"^(?:#\w[\w-]*|tag:\S+)$")
_KANA = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾝ]")
_JRUN = re.compile(r"[぀-ゟ]+|[゠-ヿー]+|[㐀-鿿々]+|[a-zA-Z]+|\d+|[。！？]|[、,]|\S")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ALNUM = re.compile(r"[^\W_]")

_KIND: dict[str, int] = {}
for _kind, _words in FUNCTION_WORDS.items():
    for _language, _list in _words.items():
        for _w in _list.split():  # a word of several languages tells none
            _KIND[_w] = C[_kind] if _w in _KIND else _SPOKEN[_kind, _language]


_AFTER_WORD = {",": C["comma"], ";": C["semi"], ":": C["colon"], "/": C["sep"], "|": C["sep"]}


def _classes(word: str) -> bytes:
    """Classes of one space-delimited word with its punctuation; content words at their first place."""
    if EXTERNAL in word:
        return bytes([C["url"]])
    if INTERNAL in word:
        return bytes([C["node"]])
    if _TAG.match(word.rstrip(",;")):
        return bytes([C["tag"]])
    if _PRICE.match(word.rstrip(",;")):
        return bytes([C["price"]])
    if _KANA.search(word):
        return _japanese(word)
    if _ITEM.match(word):
        return bytes([C["bullet"]])
    start = _ALNUM.search(word)
    if not start:
        mark = word[-1]
        kind = "bullet" if word in ("-", "*", "+") else "sep" if mark in "|/;•·–—-" else "end" if mark in ".!?…" else "comma" if mark == "," else "symbol"
        return bytes([C[kind]])
    end = len(word)
    while not _ALNUM.match(word, end - 1):
        end -= 1
    lead, core, tail = word[: start.start()], word[start.start() : end], word[end:]
    out = []
    if lead and lead[-1] in "([{\"'“«":
        out.append(C["bracket"])
    low = core.lower()
    if low in _KIND:
        out.append(_KIND[low])
    elif core[0].isdigit():
        out.append(C["num"])
    elif "_" in core or "=" in core or "(" in core or "<" in core:
        out.append(C["code"])
    elif "а" <= low[0] <= "ё":
        out.append(C["verb" if low.endswith(VERB_ENDINGS) else "adjective" if low.endswith(ADJECTIVE_ENDINGS) else "cyrillic"])
    else:
        if low[1:2] in "'’" and low[0] in ELIDED:
            out.append(_SPOKEN["det", "fr"])
            core = core[2:]
        out.append(C["upper" if len(core) > 1 and core.isupper() else "cap" if core[:1].isupper() else "low"])
    for mark in tail:
        if mark in ".!?…":
            out.append(C["end"])
            break
        if mark in _AFTER_WORD:
            out.append(_AFTER_WORD[mark])
            break
        if mark in ")]}\"'”»" and out[-1] != C["bracket"]:
            out.append(C["bracket"])
    return bytes(out)


def _japanese(word: str) -> bytes:
    out = []
    for m in _JRUN.findall(word):
        if "぀" <= m[0] <= "ゟ":
            kind = "jparticle"
        elif m in "。！？":
            kind = "end"
        elif m in "、,":
            kind = "comma"
        elif m.isdigit():
            kind = "num"
        elif m.isalnum():
            kind = "jcontent"
        else:
            kind = "sep" if m in "/|;" else "symbol"
        out.append(C[kind])
    return bytes(out)


@dataclass(slots=True)
class Stretch:
    kind: str  # text, table or code
    source: str
    code: bytes


class _Known(dict):
    """Classes of the words met so far."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        code = _classes(word)
        if len(word) < 40:
            self[word] = code
        return code


class Reader:
    """Turns texts into stretches of word classes."""

    def __init__(self) -> None:
        self.class_of = _Known().__getitem__

    def stretches(self, text: str) -> tuple[list[Stretch], int]:
        """The stretches of a text, and its language (a number; that after the last stands for none); layout is left out.

        Links to other sites and links to pages of the same vault become one
        mark each; markup, cue numbers and cue times vanish.  Short lines are
        joined with their neighbours until they can be judged.
        """
        if "<" in text:
            text = _without_markup(text)
        hosts = "://" in text or _DOTTED.search(text) is not None
        cues = "-->" in text
        class_of = self.class_of
        out: list[Stretch] = []
        lines: list[str] = []
        codes: list[bytes] = []
        size = 0
        fence = False
        held = "text"

        def close() -> None:
            nonlocal lines, codes, size
            if lines:
                out.append(Stretch(held, "\n".join(lines), _BREAK.join(codes)))
            lines, codes, size = [], [], 0

        for raw in text.splitlines():
            line = raw.strip()
            if line.startswith("```"):
                close()
                fence = not fence
                continue
            if not line or (cues and (line.isdigit() or line == "WEBVTT" or _CUE_TIME.match(line))):
                if size >= STRETCH:
                    close()
                continue
            if fence:
                out.append(Stretch("code", line, b""))
                continue
            kind = "table" if line.startswith("|") and line.endswith("|") else "text"
            if kind != held:
                close()
                held = kind
            shown = _NUMBER.sub("", line) if line[0].isdigit() else line
            if hosts or "](" in line:
                shown = _marked(shown)
            code = b"".join(map(class_of, shown.split()))
            if len(code) >= STRETCH:
                if lines:
                    close()
                out.append(Stretch(kind, line, code))
                continue
            lines.append(line)
            codes.append(code)
            size += len(code)
        close()
        votes = _VOTES @ np.bincount(np.frombuffer(b"".join([s.code for s in out]), dtype=np.uint8), minlength=256)
        for s in out:
            s.code = s.code.translate(_SILENT)
        return out, int(votes.argmax()) if votes.any() else len(LANGUAGES)


_BREAK = bytes([C["break"]])


def _marked(line: str) -> str:
    """A line with a mark in place of each link."""
    if "](" in line:
        line = _MARKDOWN_LINK.sub(lambda m: f" {m.group(1)} {_mark(m.group(2))} ", line)
    if "://" in line or _DOTTED.search(line):
        line = _HOST.sub(lambda m: f" {EXTERNAL} " if _is_host(m.group()) else m.group(), _URL.sub(f" {EXTERNAL} ", line))
    return line


def _is_host(word: str) -> bool:
    """A host name: labels, of which one after the first is a known ending."""
    labels = word.partition("/")[0].split(".")
    return any(labels[i].lower() in HOST_ENDINGS and labels[i - 1] for i in range(1, len(labels)))


def _mark(target: str) -> str:
    return EXTERNAL if _URL.match(target) or target.startswith("//") or _is_host(target) else INTERNAL


def _without_markup(text: str) -> str:
    """HTML as lines; the target of a link to another site stays behind its title, as it is part of the text's characters."""
    target = ""

    def shown(m: re.Match) -> str:
        nonlocal target
        tag = m.group()
        name = _TAG_NAME.match(tag)
        name = name.group(1).lower() if name else ""
        if name != "a":
            return "\n" if name in _BREAKS else " "
        before, target = target, ""
        if tag[1] != "/" and (found := _TARGET.search(tag)):
            target = found.group(1) if _mark(found.group(1)) == EXTERNAL else INTERNAL
        return f" {before} "

    return _HTML.sub(shown, text) + " " + target


_FUNCTIONS = [C[k] for k in _FUNCTION_KINDS]
_MARKS = bytes(C[k] for k in ("comma", "semi", "end", "sep", "colon", "bracket", "bullet", "symbol", "break"))
_NOT_PROSE = {C[k] for k in ("url", "tag", "price", "sep", "node")}


def _is_sentence(stretch: Stretch) -> bool:
    """Stretches on which the model is trained: they end sentences, hold enough function words and no link or tag, and do not repeat themselves."""
    code = stretch.code
    kinds = set(code)
    if kinds & _NOT_PROSE or C["end"] not in kinds:
        return False
    functions = sum(map(code.count, _FUNCTIONS))
    if not functions or functions < FUNCTION_SHARE * len(code.translate(None, _MARKS)):
        return False
    long = [w for w in stretch.source.lower().split() if len(w) > 3]
    return len(set(long)) >= DIFFERENT * len(long)


_LEAD = bytes([C["line"], C["line"]])
_RESETS = np.zeros(256, dtype=bool)
_RESETS[[*_FUNCTIONS, C["verb"], C["line"]]] = True


def _placed(codes: list[bytes]) -> np.ndarray:
    """The stretches as one sequence, two ``line`` marks before each, content words numbered from the last function word."""
    a = np.frombuffer(_LEAD + _LEAD.join(codes), dtype=np.uint8)
    content = a >= FIRST_CONTENT
    so_far = np.cumsum(content)
    place = so_far - np.maximum.accumulate(np.where(_RESETS[a], so_far, 0))
    return np.where(content, a + np.minimum(place, PLACES) - 1, a).astype(np.int32)


def _trigrams(codes: list[bytes]) -> np.ndarray:
    """Trigrams of the stretches; those that end in a ``line`` mark are kept."""
    a = _placed(codes)
    return (a[:-2] * N + a[1:-1]) * N + a[2:]


class Model:
    """Bits of each trigram in each language, with the mean and deviation of the bits of the sentences they were counted on.

    The trigrams of a language lean on those of all languages where they are
    few; texts of no language are held against all.
    """

    def __init__(self, counts: np.ndarray):
        """``counts``: a row per language, a column per trigram."""
        every = np.vstack([counts, counts.sum(axis=0)]).reshape(-1, N, N, N).astype(float)
        every[..., C["line"]] = 0
        pooled = self._shares(every[-1], None)
        rows = [self._shares(tri, pooled) for tri in every[:-1]] + [pooled]
        self.cost = -np.log2(np.stack(rows)).reshape(len(every), -1).astype(np.float32)
        self.cost.reshape(len(every), N, N, N)[..., C["line"]] = 0
        weight = every.reshape(len(every), -1)
        total = np.maximum(weight.sum(axis=1), 1e-9)
        self.mean = (weight * self.cost).sum(axis=1) / total
        self.deviation = np.sqrt((weight * (self.cost - self.mean[:, None]) ** 2).sum(axis=1) / total)
        self.mean[weight.sum(axis=1) < LEAST_TRAINED], self.deviation[weight.sum(axis=1) < LEAST_TRAINED] = self.mean[-1], self.deviation[-1]

    @staticmethod
    def _shares(tri: np.ndarray, pooled: np.ndarray | None) -> np.ndarray:
        bi = tri.sum(axis=0)
        uni = bi.sum(axis=0)
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * N)
        p2 = (bi + 2 * p1[None, :]) / (bi.sum(axis=1, keepdims=True) + 2)
        lower = p2[None, :, :] if pooled is None else 0.5 * (p2[None, :, :] + pooled)
        return (tri + 2 * lower) / (tri.sum(axis=2, keepdims=True) + 2)

    def bits(self, codes: list[bytes], language: int) -> np.ndarray:
        """Bits of each stretch."""
        if not codes:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(c) + 2 for c in codes[:-1]])
        return np.add.reduceat(self.cost[language][_trigrams(codes)], starts)

    def scores(self, codes: list[bytes], language: int, bits: np.ndarray | None = None) -> list[float]:
        """How many standard errors the mean bits of each stretch lie above those of the sentences; 0 if there were no sentences to learn from."""
        if not codes or not self.deviation[language]:
            return [0.0] * len(codes)
        n = np.array([len(c) for c in codes], dtype=float)
        bits = self.bits(codes, language) if bits is None else bits
        return ((bits / n - self.mean[language]) * np.sqrt(np.minimum(n, LONGEST)) / self.deviation[language]).tolist()


_REFERENCE = bytes(C[k] for k in ("url", "symbol", "bullet", "sep", "end", "bracket", "num", "break"))


def _made_of(stretch: Stretch) -> str:
    """What a stretch that is no prose is made of; a link, tag or price alone makes no stretch stuffing."""
    code = stretch.code
    urls, tags = code.count(C["url"]), code.count(C["tag"])
    if urls:
        # A link with at most a title is a link; a link beside a sentence is a reference.
        beside = len(code.translate(None, _REFERENCE))
        return "prose" if code.count(C["end"]) >= urls and beside >= 4 * urls else "link"
    if tags * 5 >= len(code) and tags:
        return "tag"
    if code.count(C["price"]) or _CURRENCY.search(stretch.source):
        # A sentence may name a price.
        spoken = C["end"] in code and 4 * sum(map(code.count, _FUNCTIONS)) >= len(code.translate(None, _MARKS))
        return "prose" if spoken else "goods"
    return "table" if stretch.kind == "table" else "suspect"


def _words(source: str) -> list[str]:
    """Words in lower case.

    A number belongs to the word before it, and a short line that ends in one
    is one word: lesson 1 and lesson 2 differ.
    """
    out: list[str] = []
    for line in source.lower().split("\n"):
        words: list[str] = []
        for w in _JRUN.findall(line) if _KANA.search(line) else _WORD.findall(line):
            if words and w.isdigit():
                words[-1] += " " + w
            elif w[0].isalnum() and not "\u3040" <= w[0] <= "ゟ":
                words.append(w)
        out += [" ".join(words)] if words and len(words) < STRETCH and words[-1][-1].isdigit() else words
    return out


def _repeated(stretches: list[Stretch], most: float) -> bool:
    """The words of the stretches come again and again, by themselves and in pairs."""
    said = [_words(s.source) for s in stretches]
    n = sum(map(len, said))
    if n < LEAST_WORDS:
        return False
    pairs = Counter(pair for words in said for pair in zip(words, words[1:]))
    again = 0
    for words in said:
        twice = [pairs[pair] > 1 for pair in zip(words, words[1:])]
        again += sum(a or b for a, b in zip([False, *twice], [*twice, False])) if words else 0
    return len({w for words in said for w in words}) / n**GROWTH - again / n <= most


# To the model an amount of money is a number.
_AMOUNT = bytes.maketrans(bytes([C["price"]]), bytes([C["num"]]))
KINDS = ("chars", "prose", "code", "link", "tag", "goods", "suspect", "table", "keyword")


def judge(text: str, model: Model, reader: Reader) -> dict[str, float]:
    """Characters of a text by what they are (``chars`` is all but layout), and its bits per class.

    The model decides which stretches are no prose; only these are looked at
    for what they are made of.
    """
    out = dict.fromkeys(KINDS, 0) | {"bits": 0.0}
    stretches, language = reader.stretches(text)
    read = [s for s in stretches if s.code]
    codes = [s.code.translate(_AMOUNT) for s in read]
    bits = model.bits(codes, language)
    scores = model.scores(codes, language, bits)
    other = [not LOW_Z <= z <= HIGH_Z for z in scores]
    for order in (range(1, len(read)), range(len(read) - 2, -1, -1)):
        for i in order:
            other[i] = other[i] or (scores[i] > BESIDE_Z and other[i - order.step])
    open_: dict[str, list[Stretch]] = {"suspect": [], "table": []}
    for s, strange in zip(read, other):
        made_of = _made_of(s) if strange else "prose"
        out[made_of] += len(s.source)
        if made_of in open_ and C["node"] not in s.code:  # links to pages of the vault are no keywords
            open_[made_of].append(s)
    for made_of, most in (("suspect", RICHNESS), ("table", TABLE_RICHNESS)):
        if open_[made_of] and _repeated(open_[made_of], most):
            size = sum(len(s.source) for s in open_[made_of])
            out[made_of] -= size
            out["keyword"] += size
    out["code"] = sum(len(s.source) for s in stretches if not s.code)
    out["chars"] = sum(len(s.source) for s in stretches)
    out["bits"] = float(bits.sum()) / sum(map(len, codes)) if codes else 0.0
    return out


def is_stuffed(j: dict[str, float]) -> bool:
    return j["link"] + j["tag"] + j["goods"] + j["keyword"] > FLAG_SHARE * j["chars"]


def prose_counts(documents: DataFrame, text_column: str = "text") -> np.ndarray:
    """Trigrams of word classes over the sentences of all documents, a row per language.

    Counted per task, summed by Spark; the result has at most one entry per
    language and trigram of classes, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        total = np.zeros(len(LANGUAGES) * N**3, dtype=np.int64)
        for batch in batches:
            grams = []
            for text in batch.column(0).to_pylist():
                if text:
                    stretches, language = reader.stretches(text)
                    codes = [s.code for s in stretches if s.kind == "text" and _is_sentence(s)]
                    if codes and language < len(LANGUAGES):
                        grams.append(_trigrams(codes) + language * N**3)
            if grams:
                total += np.bincount(np.concatenate(grams), minlength=len(total))
        (there,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["gram", "n"])

    counts = np.zeros(len(LANGUAGES) * N**3)
    for r in spread(documents.select(text_column)).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts.reshape(len(LANGUAGES), -1)


def stuffed_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Verdict on every document: id, the characters by kind, ``bits`` per word class, ``stuffed``.

    Null, empty and blank texts have 0 characters and are never stuffed;
    repeated rows stay repeated; extra columns are ignored.  Two passes over
    the texts, no shuffle of texts: the model is a bounded table of counts.
    """
    model = Model(prose_counts(documents, text_column))
    kind = documents.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), *[T.StructField(n, T.IntegerType()) for n in KINDS], T.StructField("bits", T.DoubleType()), T.StructField("stuffed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        nothing = dict.fromkeys(KINDS, 0) | {"bits": 0.0}
        for batch in batches:
            rows = [judge(t, model, reader) if t else nothing for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), *[pa.array([r[n] for r in rows], pa.int32()) for n in KINDS], pa.array([r["bits"] for r in rows], pa.float64()), pa.array([is_stuffed(r) for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return spread(documents.select(id_column, text_column)).mapInArrow(run, schema)


def stuffed_ids(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of the stuffed documents, each once."""
    return stuffed_documents(documents, id_column, text_column).where("stuffed").select(id_column).distinct()
