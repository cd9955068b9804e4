"""Broken prompt and response pairs.

Each pair of a question and an answer is checked for five defects, in this
order: ``empty``, ``refusal``, ``copy``, ``other_language``, ``truncated``.

* Copies: the answer's tokens are aligned with the question's, by containment
  of word shingles and by the longest common subsequence, as often as the
  question recurs; what the alignment leaves over must be next to nothing.
* Refusals: each sentence outside quotation marks is aligned by longest common
  subsequence with templates of refusals whose slots are notions (the speaker,
  a negation, answering, a source, ...); each language has its words for them.
* Other language: sentences vote by function words and script; where these say
  little, the letters are held against a trigram model of the question's
  language, trained on the questions.
* Truncated: open brackets, fences and quotation marks, cut table rows, lists
  and announcements, and sentences that stop without an end.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import spread

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

#: Words of a shingle, and the share of an answer's shingles that must be in the question.
SHINGLE, CONTAINMENT = 5, 0.8
#: Share of the question that an aligned answer covers, and share of the answer that may be left over.
COVERED, LEFT_OVER = 0.7, 0.15
#: Words between two neighbouring slots of a refusal template, at most.
GAP = 9
#: Words beside a refusal that make it an answer; a sentence without a word of the question counts a third.
ANSWER_WORDS = 12
#: Words of the question's language, as a share of all, below which the letters are asked, if there are so many words; without a trained model, if there are so many.
FEW, LEAST_WORDS, LEAST_WORDS_UNTRAINED = 0.12, 4, 8
#: Words of the question's language, as a share of all, from which an answer with few words of any other is not read by sentences.
CLEAR = 0.25
#: Standard errors of the letters' bits from which a sentence is in another language, and trigrams up to which a longer one makes that likelier.
STRANGE_Z, LONGEST = 26.0, 64
#: Trigrams of a language's questions below which it has no model.
LEAST_TRAINED = 2_000
#: Words up to which an answer without a full stop may be a complete phrase.
PHRASE_WORDS = 4

# Words that stand for "no value".
PLACEHOLDERS = set(
    """n/a na n.a none null nil nan tbd tba tbc todo undefined unknown empty blank missing placeholder xxx
    (none) [none] <none> {none} (null) (empty) (blank) [tbd] #n/a k.a keine nichts entf entfällt leer
    s/o sans néant vide ninguno ninguna vacío sin нет пусто н/д отсутствует""".split()
) | {"no answer", "no value", "no data", "not available", "not applicable", "to be done", "to be determined", "to do", "lorem ipsum", "keine angabe", "keine antwort", "sin respuesta", "sin datos", "sans réponse", "pas de réponse", "нет ответа", "нет данных"}
PLACEHOLDERS -= {"keine", "nichts", "ninguno", "ninguna", "нет", "sans", "sin", "unknown"}  # these can be answers

# The notions of refusals and their words; * stands for any ending.
NOTIONS = {
    "self": """i i'm i'd i've me my myself we us our | ich mir mich mein* wir uns unser* | je j me m moi mon ma mes nous notre
        | yo me mi mis mí nos nuestr* prefiero quiero voy creo temo dispongo desconozco ignoro puedo podemos sé sabemos tengo tenemos encuentro encontré debo soy estoy | я мне меня мной мой моя мое моё моей моего мы нам нас наш* могу можем знаю знаем нашел нашёл нашла вынужден* хочу буду смогу располагаю имею отказываюсь""",
    "not": """not no never nothing none nobody nowhere neither cannot can't won't don't didn't couldn't wouldn't isn't aren't doesn't haven't hasn't wasn't unable impossible rather lack lacks
        | nicht nichts niemand kein* nie niemals weder unmöglich fehlt fehlen | ne n pas rien aucun* jamais ni impossible manque | no nada nadie ningún ningun* nunca jamás imposible falta faltan
        | не нет никто нельзя ничего нечего ничем никак никогда ни невозможно""",
    "nothing": "nothing never nowhere | nichts nie nirgends | rien jamais | nada nunca | ничего нечего нет",
    "none": "none | keiner keine | aucun aucune | ninguno ninguna ningún",
    "answer": """answer* respond* repl* | antwort* beantwort* | répon* | respond* respuesta* contest* | ответ* отвеч*""",
    "say": """answer* respond* repl* say* said tell* discuss* comment* help* assist* provid* address* share speak* talk* elaborat* advis* offer* giv* explain* go mention* cover* describe*
        | antwort* beantwort* sag* red* helf* weiterhelf* mitteil* äußer* eingeh* sprech* besprech* erklär* erläuter* erörter* kommentier* behandel* geben erwähn* enthalt*
        | répon* dire dis disent dit aider aborder parl* trait* expliqu* comment* précis* donn* fourni* discut* évoqu* mentionn*
        | respond* contest* decir digo dicen dice ayud* trat* hablar coment* explic* dar doy ofrec* proporcion* abord* discut* mencion*
        | ответ* отвеч* сказ* скаж* обсужд* обсуд* помо* помо* говор* комментир* объясн* рассказ* дать предостав* упомина*""",
    "know": """know* idea clue aware sure certain find* found locat* determine determined derive* deduce* infer inferred see
        | weiß weiss wissen kenntnis* kenn* find* fand gefunden ableit* abgeleit* entnehm* ermittel* | sais savons connai* trouv* dédui* ai avons
        | sé sabemos conozco encontr* tengo tenemos dispongo hall* deduc* | знаю знаем знать нашел нашёл нашла найти нашлось следует понятия располага* име*""",
    "derive": "derive* deduce* infer inferred tell determine determined | ableit* abgeleit* entnehm* hervor* | dédui* ressort | deduc* desprende | следует вывести",
    "information": """answer* information info details | antwort* auskunft auskünfte information* angabe* hinweis* | répons* information* renseignement* indication* | respuesta* información informaciones datos | ответ* сведени* информаци* данных""",
    "source": """notes passage passages text texts material materials context blocks document documents sources excerpt excerpts provided supplied
        | notizen abschnitt* text texte* unterlagen material* quelle* kontext dokument* passage* | notes passage* texte* blocs document* sources contexte extrait*
        | apuntes notas bloques texto* material* documento* fuentes contexto pasaje* | заметк* материал* блок* текст* документ* источник* отрыв* контекст*""",
    "possible": """possible can can't cannot could couldn't able unable let lets allow* permit* may
        | kann können könn* lässt lassen möglich darf dürfen | permet* possible impossible peut peux pouvons mesure | posible imposible permit* puede pueden puedo podemos | можно возможно невозможно могу можем может позволя* удалось нельзя""",
    "impossible": "impossible | unmöglich | impossible | imposible | невозможно нельзя",
    "unknown": "unknown unaware | unbekannt | inconnu* ignore | desconozco ignoro | неизвестн*",
    "beyond": "beyond outside exceed* violat* breach* | außerhalb hinaus übersteig* | sort dehors dépass* hors | fuera exced* | рамк* рамок предел* вне",
    "decline": "decline declining refuse refusing reject | ablehn* lehne verweiger* | refus* décliner décline | rechaz* declin* niego | отклон* отказ*",
    "prevent": "prevent* forbid* prohibit* restrict* bar bars keeps | verbiet* untersag* hinder* | interdi* empêch* | prohíb* prohib* impid* | запрещ* меша*",
    "there": "there | gibt liegen | aucun* a | hay | нет",
    "reports": "says said states reports claims explains | sagt meldet erklärt | dit affirme indique | dice afirma indica | говорит сообщает пишет",
    "that": "that | dass | que qu | que | что",
    "courtesy": """please thank* hope sorry apolog* free welcome question you your perhaps maybe might
        | bitte danke hoffe tut entschuldig* verständnis vielleicht frage du dir dich dein* ihnen ihr* | merci vous votre vos désolé* espère peut-être question tu te ton
        | gracias favor siento disculp* espero quizá quizás usted tu te haz pregunta lamento | пожалуйста спасибо жаль надеюсь возможно извините простите вопрос вы вас вам ваш*""",
}
# Refusals as sequences of notions; the slots of one template may stand in any order, except after "=".
TEMPLATES = (
    "self not say", "self not know", "self not information", "= source not say", "source not information", "source not derive", "source nothing", "= none source say", "not possible answer", "not possible derive",
    "impossible answer", "self unknown", "self beyond", "self decline", "self prevent", "there not information",
)
# Words before which a sentence turns.
_TURN = re.compile(r";|[,—–-]\s*(?:but|yet|however|although|aber|jedoch|doch|sondern|mais|cependant|pourtant|pero|aunque|но|однако)\b", re.I)
# Function words by language.
LANGUAGE_WORDS = {
    "en": "the a an of and or is are was were that this these it its in on at to by with from for what which who how why when where does do did would should can not no yes but only if as about after before while until each every because they has have be there then than under without across near he she we you i my your".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war nicht kein keine auf für mit aus zu zum zur nach vor bei über unter zwischen ohne durch von im am wie was wann warum wer wo dass wenn weil aber auch nur sich wird werden hier ja nein dazu am als er es ich diese dieser dieses mir jedes jede später deshalb".split(),
    "fr": "le la les un une des du de et ou est sont dans sur par pour avec sans sous entre après avant pendant chez que qui quoi quand comment pourquoi où il elle ne pas plus oui non mais au aux ce cette ces cet se son sa ses l'on d'un d'une quel quelle voir puis en à faut-il fait lorsque je".split(),
    "es": "el la los las un una unos unas del de y o es son en con por para sin sobre bajo entre tras desde que qué quién cuándo cómo cuál dónde se no sí pero al su sus lo más cada cuando este esta estos después antes durante puede hay según junto también no solo a".split(),
    "ru": "и в во на с со к по из от до у о об для без над под при через после перед что как когда почему зачем где кто это этот эта эти не ни да нет но а или если он она оно они его её их мы вы я же ли бы так все каждой каждый".split(),
    "it": "il lo la gli le un uno una di del della dei e o è sono nel nella con per che come quando perché non più anche si sul alla dal questo questa".split(),
    "pt": "o a os as um uma de do da dos das e ou é são em no na com por para que como quando não mais também se ao pelo este esta".split(),
    "nl": "de het een van en of is zijn in op aan met voor naar uit bij dat die dit niet geen ook maar als wanneer hoe waarom wordt door over na".split(),
}
_LANGUAGES: dict[str, list[str]] = {}
for _lang, _words in LANGUAGE_WORDS.items():
    for _w in set(_words):
        _LANGUAGES.setdefault(_w, []).append(_lang)
_LETTERS = {"de": "ß", "fr": "èêëœùûîï", "es": "ñ¿¡", "pt": "ãõ", "it": "ìò"}

# Words that can not end a sentence.
DANGLING = set(
    """the a an of and or that which who whose if because when while into onto with from than its their his her my your our this these each every is are was were
    der die das den dem des ein eine einen einem einer und oder dass wenn weil für mit von im am zum zur jedes jede sondern
    le la les un une des du de et ou que qui dans sur par pour avec sans ce cette ces au aux l d qu
    el la los las un una del de y o que en con por para al su sus cada
    и в на с к из от для без над под при через что или но если""".split()
)

# Words after which not even a full stop ends a sentence.
NEVER_LAST = set("the an and or of their its every und oder dass et ou le les el los las y и или".split()) - {"y"}

#: Words remembered by one Python worker, and characters of the longest.
CACHE_ENTRIES, LONGEST_KEPT = 200_000, 40

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
_FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
_FENCED = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_IMAGE = re.compile(r"!\[[^\[\]]*\]\([^()]*\)")
_IMAGE_START = re.compile(r"!\[[^\[\]]*\]\(")
_HTML = re.compile(r"<!--(?:(?!<!--).)*?-->|</?[a-zA-Z][^<>]*>", re.S)
_QUOTE = re.compile(r"[\"“«„]")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\"”\n]*[“\"”]")
_MARKED = re.compile(r"[<&\[`~]")
_LETTER = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+|(?<=[。！？])|\n+")
_LABEL = re.compile(r"^[\W_]*(?:(?:your |the |my )?(?:original )?(?:question|prompt|answer|response|reply)(?: is| was)?|you asked|q|a|frage|antwort|die frage(?: lautet)?|du fragst|(?:la )?question(?: est)?|réponse|vous demandez|(?:la )?pregunta(?: es)?|respuesta|preguntas|вопрос|ответ|вы спросили|вы спрашиваете)\s*[:：]\s*", re.I)
_NUMBERED = re.compile(r"^\s*\d+[.)]\s+")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])(?:\s+|$)")


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("’", "'"))


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, by bit vectors: one word operation per token of ``b``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# --- empty ---------------------------------------------------------------


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation, empty markup or a placeholder."""
    if answer is None:
        return True
    if len(answer) > 80 and not _MARKED.search(answer):  # plain text, longer than any placeholder
        plain = " ".join(answer.split())
        if len(plain) > 80 and _LETTER.search(plain):
            return False
    text = _INVISIBLE.sub("", html.unescape(answer))
    text = re.sub(r"^[ \t]*(?:```|~~~)[^\n]*$", " ", text, flags=re.M)
    text = re.sub(r"!?\[\s*\]\([^()]*\)", " ", text)
    text = _HTML.sub(" ", text).strip()
    if not any(c.isalnum() or (not c.isascii() and unicodedata.category(c) in ("So", "Sc", "Sm")) for c in text):
        return True
    short = " ".join(text.lower().split())
    return len(short) <= 40 and (short in PLACEHOLDERS or short.strip(" .:;!?*_`-—–\"'()[]{}<>#|") in PLACEHOLDERS)


# --- copy ----------------------------------------------------------------


def is_copy(question: str, answer: str, asked: list[str] | None = None, tokens: list[str] | None = None) -> bool:
    """The answer gives back the question and adds nothing.

    ``asked`` and ``tokens``: those of question and answer, if they are known.
    """
    q = _tokens(question) if asked is None else asked
    there = set(_tokens(answer) if tokens is None else tokens)
    if sum(w in there for w in q) < COVERED * len(q):
        return False
    a = _tokens(_LABEL.sub("", _HTML.sub(" ", answer))) if q else []
    if not a:
        return False
    spare = max(min(1, len(q) - 1), LEFT_OVER * len(a))
    shingles = min(SHINGLE, len(q), len(a))
    of_q = {tuple(q[i : i + shingles]) for i in range(len(q) - shingles + 1)}
    inside = sum(tuple(a[i : i + shingles]) in of_q for i in range(len(a) - shingles + 1)) / (len(a) - shingles + 1)
    if len(a) <= 1.3 * len(q):
        common = _lcs(q, a)
        return common >= COVERED * len(q) and len(a) - common <= spare
    # A longer answer may repeat the question: each line or sentence must align with it, and together they cover the question's sentences.
    if inside < max(0.4, CONTAINMENT * (1 - (shingles - 1) / len(q)) * 0.8):
        return False
    parts = Counter(tuple(_tokens(_LABEL.sub("", part))) for part in _SENTENCE.split(answer))
    if sum(n * (len(words) - _lcs(q, words)) for words, n in parts.items()) > spare:
        return False
    asked = Counter(tuple(_tokens(part)) for part in _SENTENCE.split(question))
    covered = sum(n * (len(words) if words in parts else max(_lcs(words, part) for part in parts)) for words, n in asked.items())
    return covered >= COVERED * len(q)


# --- refusal -------------------------------------------------------------

_BIT = {name: 1 << i for i, name in enumerate(NOTIONS)}


def _notion_words() -> tuple[dict[str, int], dict[str, int]]:
    """Notions of whole words, and of beginnings of words."""
    whole: dict[str, int] = {}
    begins: dict[str, int] = {}
    for name, words in NOTIONS.items():
        for w in words.replace("|", " ").split():
            into, w = (begins, w[:-1]) if w.endswith("*") else (whole, w)
            into[w] = into.get(w, 0) | _BIT[name]
    return whole, begins


_WHOLE, _BEGINS = _notion_words()
_LONGEST_BEGINNING = max(map(len, _BEGINS))


class _Notions(dict):
    """Notions of the words met so far, as bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        found = _WHOLE.get(word, 0)
        for n in range(2, min(len(word), _LONGEST_BEGINNING) + 1):
            found |= _BEGINS.get(word[:n], 0)
        if "'" in word and not found:
            for part in word.split("'"):
                found |= _WHOLE.get(part, 0)
                for n in range(2, min(len(part), _LONGEST_BEGINNING) + 1):
                    found |= _BEGINS.get(part[:n], 0)
        if len(word) <= LONGEST_KEPT:
            self[word] = found
        return found


_NOTIONS = _Notions()


def _aligned(slots: tuple[int, ...], words: list[int], ordered: bool = False) -> int | None:
    """Place of the first of the words that fill all slots close to each other; None if there is none.

    Each slot takes a word of its own, but a verb in the first person fills the
    speaker's slot too.  The words that fill any slot are taken in order; their longest common
    subsequence with the template, in whichever order its slots stand, must be
    the whole template.
    """
    any_of = 0
    for slot in slots:
        any_of |= slot
    filling = [(i, w) for i, w in enumerate(words) if w & any_of]
    full = (1 << len(slots)) - 1
    reach: dict[int, tuple[int, int]] = {}  # filled slots -> (last place, first place), the latest kept
    for i, w in filling:
        here = {}
        for k, slot in enumerate(slots):
            if w & slot:
                own = 1 << k
                if not ordered or k == 0:
                    here[own] = (i, i)
                for filled, (last, first) in reach.items():
                    if not filled & own and i - last <= GAP + 1 and (not ordered or filled == own - 1):
                        here[filled | own] = max(here.get(filled | own, (-1, -1)), (i, first))
        if w & _BIT["self"] and len(here) > 1:  # the speaker's slot is the first of a template that has one
            here |= {filled | 1: at for filled, at in here.items() if slots[0] == _BIT["self"]}
        if full in here:
            return here[full][1]
        reach |= here
    return None


_SLOTS = [(tuple(_BIT[name] for name in template.strip("= ").split()), template.startswith("=")) for template in TEMPLATES]
_NEEDED = [sum(slots) for slots, _ in _SLOTS]
_NEGATIVE = _BIT["not"] | _BIT["nothing"] | _BIT["beyond"] | _BIT["decline"] | _BIT["prevent"] | _BIT["unknown"]
_KIND = _BIT["courtesy"] | _BIT["self"]


def _refuses(words: list[int]) -> bool:
    """A sentence, as notions, fills a template and is not reported of somebody else."""
    there = 0
    for w in words:
        there |= w
    if not there & _NEGATIVE:
        return False
    for (slots, ordered), needed in zip(_SLOTS, _NEEDED):
        if needed & there == needed:
            at = _aligned(slots, words, ordered)
            if at is not None and not (there & _BIT["reports"] and _reported(words[:at + 1])):
                return True
    return False


def _reported(before: list[int]) -> bool:
    """A report (says that) stands before."""
    return any(a & _BIT["reports"] and b & _BIT["that"] for a, b in zip(before, before[1:]))


def is_refusal(answer: str, question: str = "", tokens: list[str] | None = None) -> bool:
    """Declines, or says that there is no answer; what else is said are courtesies or next to nothing.

    ``tokens``: those of the answer, if they are known.
    """
    there = 0
    for n in map(_NOTIONS.__getitem__, set(_tokens(_INVISIBLE.sub("", answer)) if tokens is None else tokens)):
        there |= n
    if not there & _NEGATIVE or not any(needed & there == needed for needed in _NEEDED):
        return False
    text = _FENCED.sub(" ", answer) if "```" in answer or "~~~" in answer else answer
    low = _INVISIBLE.sub("", text).lower().replace("’", "'")
    said = _QUOTED.sub(" ", low) if _QUOTE.search(low) else low
    asked = {w for w in _tokens(question) if len(w) > 3}
    refused, other = False, 0.0
    for sentence in _SENTENCE.split(said):
        for part in _TURN.split(sentence):
            words = _TOKEN.findall(part)
            if not words:
                continue
            notions = [_NOTIONS[w] for w in words]
            if _refuses(notions):
                refused = True
            elif not any(n & _KIND for n in notions):
                other += len(words) if any(w in asked for w in words) else len(words) / 3
    return refused and other <= ANSWER_WORDS


# --- other language ------------------------------------------------------


_SCRIPTS = (("latin", "a", "z"), ("latin", "À", "ɏ"), ("latin", "Ḁ", "ỿ"), ("ru", "Ѐ", "ӿ"), ("ja", "\u3040", "ヿ"), ("cjk", "㐀", "鿿"), ("ko", "가", "힣"), ("el", "Ͱ", "Ͽ"), ("ar", "\u0600", "ۿ"), ("he", "\u0590", "\u05ff"), ("hi", "\u0900", "ॿ"), ("th", "\u0e00", "\u0e7f"))


def _script(word: str) -> str | None:
    c = word[0].lower()
    return next((name for name, first, last in _SCRIPTS if first <= c <= last), None)


class _Votes(dict):
    """Votes of the words met so far: pairs of language and weight."""

    def __missing__(self, word: str) -> tuple[tuple[str, float], ...]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        out: Counter = Counter()
        script = _script(word)
        if script == "latin":
            for part in (word, *word.split("'")) if "'" in word else (word,):
                for lang in _LANGUAGES.get(part, ()):
                    out[lang] += 1 / len(_LANGUAGES[part])
            for lang, letters in _LETTERS.items():
                if n := sum(map(word.count, letters)):
                    out[lang] += 0.5 * n
        elif script in ("cjk", "ja"):
            out["ja"] += max(1, len(word) // 4)
        elif script:
            out[script] += 1
        found = tuple(out.items())
        if len(word) <= LONGEST_KEPT:
            self[word] = found
        return found


_VOTES = _Votes()


def _votes(words: list[str]) -> dict[str, float]:
    """Languages of some words: function words, letters and script, one vote each."""
    out: dict[str, float] = {}
    for some in map(_VOTES.__getitem__, words):
        for lang, weight in some:
            out[lang] = out.get(lang, 0.0) + weight
    return out


def language(text: str | list[str]) -> tuple[str | None, float]:
    """The language with most votes and its lead; None if there is none."""
    v = sorted(_votes(_tokens(text) if isinstance(text, str) else text).items(), key=lambda x: -x[1])
    if not v:
        return None, 0.0
    return v[0][0], v[0][1] - (v[1][1] if len(v) > 1 else 0.0)


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Letters:
    """Trigrams of letters of one language: bits of each, with mean and deviation over the text they were counted on."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values())
        pairs: Counter = Counter()
        for g, n in counts.items():
            pairs[g[:2]] += n
        letters = len({c for g in counts for c in g}) + 1
        # One half of a count is shared by all letters, so an unseen trigram costs the more the better its pair is known.
        self.bits = {g: -math.log2((n + 0.5 / letters) / (pairs[g[:2]] + 0.5)) for g, n in counts.items()}
        self.unseen = {p: -math.log2(0.5 / letters / (n + 0.5)) for p, n in pairs.items()}
        self.least = math.log2(letters)
        self.mean = sum(n * self.bits[g] for g, n in counts.items()) / self.total if self.total else 0.0
        self.deviation = math.sqrt(sum(n * (self.bits[g] - self.mean) ** 2 for g, n in counts.items()) / self.total) if self.total else 0.0

    def score(self, words: list[str]) -> float:
        """Standard errors by which the words' letters cost more than those of the language."""
        grams = [g for w in words for g in _grams(w)]
        if not grams or not self.deviation:
            return 0.0
        bits = sum(self.bits[g] if g in self.bits else self.unseen.get(g[:2], self.least) for g in grams)
        return (bits / len(grams) - self.mean) * math.sqrt(min(len(grams), LONGEST)) / self.deviation


def language_letters(pairs: DataFrame, question: str = "question") -> dict[str, Letters]:
    """Letter trigrams of the questions of each language, over all rows.

    Counted per batch in Python, summed by Spark.  The result has at most one
    entry per language and three letters, whatever the number of rows, so it
    may go to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    tokens = _tokens(text)
                    v = sorted(_votes(tokens).items(), key=lambda x: -x[1])
                    if v and v[0][1] - (v[1][1] if len(v) > 1 else 0.0) >= 1.0:
                        words.setdefault(v[0][0], Counter()).update(tokens)
        rows: Counter = Counter()
        for lang, counted in words.items():
            for w, n in counted.items():
                if _script(w):
                    for g in _grams(w):
                        rows[lang, g] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "gram", "n"])

    counts: dict[str, dict[str, int]] = {}
    for r in spread(pairs.select(question)).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return {lang: Letters(c) for lang, c in counts.items() if sum(c.values()) >= LEAST_TRAINED}


def _prose(answer: str) -> list[str]:
    """Sentences of an answer without code, tables, images, quoted lines and quotations."""
    text = answer
    if _MARKED.search(text):
        text = _IMAGE.sub(" ", _HTML.sub(" ", _FENCED.sub("\n", text)))
    if "|" in text or ">" in text:
        text = "\n".join(x for x in text.split("\n") if not x.lstrip().startswith((">", "|")))
    if _QUOTE.search(text):
        text = _QUOTED.sub(" ", text)
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


def is_other_language(question: str, answer: str, letters: dict[str, Letters] | None = None, of_question: list[str] | None = None, tokens: list[str] | None = None) -> bool:
    """Most of the answer's prose is in another language than the question.

    ``letters`` holds the trained models; without one for the question's
    language, only longer sentences with hardly any of its function words count.
    ``of_question`` and ``tokens``: those of question and answer, if they are known.
    """
    asked, lead = language(question if of_question is None else of_question)
    if asked is None or lead <= 0:
        return False
    if tokens is not None:  # no sentence can outvote so many words of the question's language
        v = _votes(tokens)
        mine = v.pop(asked, 0.0)
        if mine >= CLEAR * len(tokens) and 3 * max(v.values(), default=0.0) <= mine:
            return False
    own = foreign = 0.0
    strong = 0.0
    for sentence in _prose(answer):
        words = _tokens(sentence)
        v = _votes(words)
        best, most = max(v.items(), key=lambda x: x[1]) if v else (asked, 0.0)
        mine = v.get(asked, 0.0)
        weight = len(sentence.strip())
        if best != asked and most - mine >= 0.75:
            foreign += weight
            strong += most - mine
            if most - mine < 1.5 and mine < FEW * len(words) and _is_strange(words, asked, letters):
                strong += 1.5
        elif mine < FEW * len(words) and _is_strange(words, asked, letters):
            foreign += weight
            strong += 1.5
        elif mine or (v and best == asked):
            own += weight
    return foreign > own and strong >= 1.5


def _is_strange(words: list[str], asked: str, letters: dict[str, Letters] | None) -> bool:
    """Words with hardly any function word of ``asked`` whose letters are not those of that language."""
    spelled = [w for w in words if _script(w)]
    model = (letters or {}).get(asked)
    if model is None:
        return len(spelled) >= LEAST_WORDS_UNTRAINED
    return len(spelled) >= LEAST_WORDS and model.score(spelled) > STRANGE_Z


# --- truncated -----------------------------------------------------------


def is_truncated(answer: str) -> bool:
    """The answer stops before its end."""
    text = _INVISIBLE.sub("", answer).replace("\r\n", "\n").rstrip()
    if not text:
        return False
    if len(_FENCE.findall(text)) % 2:
        return True
    lines = text.split("\n")
    last = lines[-1].strip()
    if last.startswith(("```", "~~~")):
        return False
    if last.startswith("|"):
        return _cut_row(lines)
    if lines[-1].startswith(("    ", "\t")) and not _BULLET.match(last):
        return False
    if _BULLET.match(last) and not _BULLET.sub("", last).strip():
        return True  # a bullet without an item
    body = _BULLET.sub("", last)
    if body.startswith(">"):
        body = body.lstrip("> ")
    if _open_bracket(body):
        return True
    bare = re.sub(r"[*_`]+$", "", body).rstrip()
    if not bare:
        return False
    if bare.endswith(")") and "![" in bare and _IMAGE_START.match(bare, bare.rindex("![")):
        return False
    closed = bare.rstrip("\"'”»’)]")
    if not closed:
        return False
    end = closed[-1]
    words = _tokens(bare)
    if end in ",;:—–-/(&" or (end == "|"):
        return True
    if end in ".!?。！？…":
        if bare.endswith(("...", "…")):
            return True
        return end == "." and len(words) > 1 and words[-1] in NEVER_LAST
    if re.search(r"[\u3040-ヿ㐀-鿿]", end):
        return len(bare) > 12 and not _BULLET.match(last)
    if last.startswith("#"):
        return True  # a heading with nothing below
    if _BULLET.match(last):
        return _cut_item(lines, words)
    if words and words[-1] in DANGLING:
        return True
    # Prose without an end; a short phrase needs none.
    return len(words) > PHRASE_WORDS or (len(lines) > 1 and len(words) > 0 and _is_prose_before(lines))


def _is_prose_before(lines: list[str]) -> bool:
    """The line before ends a sentence, so the last line should too."""
    before = [x.strip() for x in lines[:-1] if x.strip()]
    return bool(before) and before[-1][-1] in ".!?" and not before[-1].startswith(("|", ">", "```"))


def _cut_row(lines: list[str]) -> bool:
    """The last row of a table is open, or has fewer cells than the first, or the table has a head only."""
    table = []
    for line in reversed(lines):
        if not line.strip().startswith("|"):
            break
        table.append(line.strip())
    table.reverse()
    last = table[-1]
    if not last.endswith("|") or len(last) < 2:
        return True
    cells = [x.count("|") for x in table]
    if cells[-1] < cells[0]:
        return True
    rule = [i for i, x in enumerate(table) if re.fullmatch(r"[|:\-\s]+", x) and "-" in x]
    return len(table) == 1 or (bool(rule) and rule[-1] == len(table) - 1)


def _cut_item(lines: list[str], words: list[str]) -> bool:
    """The last item of a list breaks off, judged by its neighbours."""
    items = [x.strip() for x in lines if _BULLET.match(x.strip())]
    if words and words[-1] in DANGLING:
        return True
    before = items[:-1]
    if before and all(x[-1] in ".!?" for x in before):
        return True
    return not words


def _open_bracket(text: str) -> bool:
    depth = 0
    for c in text:
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
    # Emoticons and numbering such as "a)" close what was not opened; only what stays open counts.
    return depth > 0 or text.count("“") > text.count("”") + text.count("\"") and "„" not in text or text.count("«") > text.count("»") or text.count('"') % 2 == 1


# --- pairs ---------------------------------------------------------------


def defect(question: str | None, answer: str | None, letters: dict[str, Letters] | None = None) -> str | None:
    """The defect of a pair, or None."""
    if is_empty(answer):
        return "empty"
    question = question or ""
    asked, tokens = _tokens(question), _tokens(_INVISIBLE.sub("", answer))
    if is_refusal(answer, question, tokens):
        return "refusal"
    if is_copy(question, answer, asked, tokens):
        return "copy"
    if is_other_language(question, answer, letters, asked, tokens):
        return "other_language"
    if is_truncated(answer):
        return "truncated"
    return None


def defective_pairs(pairs: DataFrame, key: str = "answer_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """``key`` and ``defect`` of each defective pair, each key once.

    Null answers are ``empty``; a null question can be neither copied nor in
    another language.  Repeated rows count once; if rows of one key differ,
    the first defect in the order of :data:`DEFECTS` holds.  The texts are
    mapped where they lie, after one pass over the questions that trains the
    letters of each language; only defective keys are shuffled.
    """
    kind = pairs.schema[key].dataType
    letters = language_letters(pairs, question)
    schema = T.StructType([T.StructField(key, kind), T.StructField("_rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(q, a, letters) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([DEFECTS.index(found[i]) for i in keep], pa.int32())], names=[key, "_rank"])

    ranked = spread(pairs.select(key, question, answer)).mapInArrow(run, schema).groupBy(key).agg(F.min("_rank").alias("_rank"))
    return ranked.select(key, F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("_rank") + 1).alias("defect"))
