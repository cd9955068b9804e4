import time

import pytest

from docweave.llm import pairs as P
from tests.conftest import rows

Q = "Why does the kiln drain the shared glossary?"
GOOD = [
    "The kiln drains the shared glossary because the caption limits the average flow.", "42", "No.", "Yes, but only in small steps.", "About 83 minutes", "The naïve counter", "None of them.",
    "The run ends with \"sorry, nothing found\" and keeps the spare fuse as it was.", "It declines only at the end of the term, and it then names the index.",
    Q + " The caption limits the average flow.", "The points are:\n- The slow passages\n- The average flow", "It drains it.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "See this:\n\n```python\nprint(1)\n```",
    "It does.\n\n![A picture](x.png)", "It says \"der Ofen ist kalt und die Brücke auch\", and the kiln repeats it.", "It is as it was.", "0", "The kiln does (see figure 4).", "> Печь хранит словарь.\n\nThe kiln keeps the glossary that the caption limits.",
]
BAD = {
    "empty": [None, "", " \n", "​﻿", "—", "...", "?", "**", "> ", "# ", "<br>", "![]()", "```\n```", "```text\n\n```", "| | |\n| --- | --- |", "- \n- ", "n/a", "N/A.", "null", "(none)", "TBD", "&nbsp;"],
    "refusal": ["I can't answer this question.", "Sorry, I don't know the answer. Please ask something else.", "That is a good question. As a study assistant, nothing in the passage lets me answer that. I hope you understand.",
                "Leider gilt: eine Antwort lässt sich daraus nicht ableiten.", "Désolé, je ne peux pas répondre à cette question.", "Lo siento, pero no sé la respuesta.", "К сожалению, мне нельзя обсуждать эту тему.", "I’m sorry, but I cannot help with that."],
    "copy": [Q, Q.lower().rstrip("?"), "Question: " + Q, "**" + Q + "**", Q + "\n\n" + Q, "You asked: " + Q, Q.replace("the shared", "shared"), "## " + Q],
    "other_language": ["Der Ofen leert das gemeinsame Glossar, weil die Fußnote den Abfluss begrenzt.", "El horno vacía el glosario común porque la leyenda limita el caudal.", "Печь опустошает общий словарь, потому что подпись ограничивает расход.", "窯は共通の用語集を空にします。説明文は平均流量を制限します。"],
    "truncated": ["The kiln drains the shared glos", "The kiln drains the", "The kiln drains the glossary. The caption limits;", "The points are:", "The points are:\n- The kiln drains it.\n- The caption lim", "- ", "It does:\n```py\nx = 1", "| a | b |\n| --- | --- |\n| 1 | 2",
                  "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |", "The kiln drains the glossary (see figure", "The kiln drains it. The caption limits –", "About 42 of 260 and"],
}


@pytest.mark.parametrize("answer", GOOD)
def test_good(answer):
    assert P.defect(Q, answer) is None


@pytest.mark.parametrize("kind,answer", [(k, a) for k, xs in BAD.items() for a in xs if not (k == "truncated" and a == "- ")])
def test_bad(kind, answer):
    assert P.defect(Q, answer) == kind


def test_languages():
    assert P.defect("Wann misst die Brücke den Abfluss?", "The bridge measures the flow before the lesson.") == "other_language"
    assert P.defect("Faut-il garder la liste ?", "Oui.") is None
    assert P.defect("¿Cuántas páginas tiene la ficha?", "97") is None
    assert P.defect("Как план хранит список?", "План хранит список до начала занятия.") is None


def test_lcs_against_brute_force():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert P._lcs(a, b) == t[-1][-1]


def test_long_texts():
    assert P.defect(Q, "The kiln drains it. " * 20000) is None
    assert P.defect("a b " * 5000, "word " * 20000) == "truncated"


def test_table(spark):
    frame = spark.createDataFrame([
        (1, Q, None, "x"), (1, Q, None, "x"), (2, Q, "It does.", "x"), (3, None, "It does.", "x"), (4, None, None, "x"), (5, Q, Q, "x"), (6, "", "n/a", "x"), (7, Q, "It does.", "x"), (7, Q, "The kiln drains the", "x"),
    ], "answer_id long, question string, answer string, defect string")
    got = P.defective_pairs(frame)
    assert got.columns == ["answer_id", "defect"]
    assert rows(got) == [(1, "empty"), (4, "empty"), (5, "copy"), (6, "empty"), (7, "truncated")]
    assert P.defective_pairs(frame.limit(0)).count() == 0


def test_copies_of_any_length():
    two = "Why does the kiln drain the shared glossary? When does the caption limit the average flow?"
    for n in (2, 10, 70, 500):
        assert P.defect(Q, " ".join([Q] * n)) == "copy" and P.defect(two, " ".join([two] * n)) == "copy", n
    assert P.defect(two, "\n".join(reversed(two.replace("? ", "?|").split("|"))) + "\n" + two) == "copy"
    assert P.defect("Why?", "Why?") == "copy" and P.defect("Why?", "why? Why?") == "copy"
    for question, answer in (("Why?", "Because."), ("Kilns?", "Kilns, yes."), ("Why?", "Why, why not?"), ("?", "Yes."), (two, two + " The kiln drains it because the bridge deck collects the heading path.")):
        assert P.defect(question, answer) is None, (question, answer)


def test_closing_images_of_any_length():
    for target in ("x.png", "media/" + "long-name/" * 60 + "x.png", "data:image/png;base64," + "iVBORw0KGgo" * 3000, "media/plate_(1).png"):
        for head in ("The kiln drains the shared glossary in small steps. ", "It does.\n\n", "The kiln drains the glossary, and the caption limits it in small steps.\n- "):
            assert P.defect(Q, f"{head}![A picture of the kiln]({target})") is None, (head, target[:40])
    assert P.defect(Q, "It does. ![A picture](" + "a" * 3000) == "truncated"
    began = time.time()
    P.defect(Q, "![a](" * 40000 + ")" * 40000)
    P.defect(Q, "![" * 100000 + ")")
    assert time.time() - began < 5


# Refusals in wordings that the list of the test data does not hold.
OTHER_REFUSALS = {
    "en": [
        'My guidelines prevent me from responding here.',
        "That is something I simply can't tell you.",
        'Regrettably, I have no idea.',
        'We are unable to share any details on that.',
        'Nobody gave me enough material to answer this.',
        'I would prefer not to talk about it.',
        'The document does not cover this, so I must pass.',
        "There's no answer to be found in these pages.",
        "It isn't possible for me to give an answer based on this passage.",
        'Such a request goes beyond my competence.',
        "I'm afraid the text never says.",
        "I couldn't tell you.",
        'I am not sure how to answer that.',
        'Providing an answer here is not something I am allowed to do.',
        'The supplied notes contain no information about the kiln.',
        "I really couldn't say.",
        'We cannot comment on ongoing matters.',
        'Answering would violate the rules I follow.',
        'None of the blocks mentions it.',
        'I must refuse.',
        'I do not have access to that information.',
        'My instructions forbid me to talk about this.',
        "The question can't be answered with the material at hand.",
        'Sorry, that topic is off limits for me.',
        'It is beyond what I am able to discuss.',
    ],
    "de": [
        'Das kann ich leider nicht sagen.',
        'Hierzu liegen mir keine Angaben vor.',
        'Tut mir leid, das weiß ich nicht.',
        'Darauf kann ich keine Antwort geben.',
        'In den Unterlagen finde ich dazu nichts.',
        'Diese Bitte muss ich leider ablehnen.',
        'Dazu darf ich mich nicht äußern.',
        'Der Text enthält hierzu keine Information.',
        'Das liegt außerhalb meiner Zuständigkeit.',
        'Eine Antwort ist auf dieser Grundlage nicht möglich.',
        'Darüber darf ich nicht reden.',
        'Ich bin nicht befugt, das zu beantworten.',
        'Leider fehlt mir dazu jedes Wissen.',
        'Auf diese Frage habe ich keine Antwort.',
        'Das geht aus den Notizen nicht hervor.',
        'Ich möchte dazu lieber nichts sagen.',
    ],
    "fr": [
        "Désolé, je l'ignore.",
        "Je n'ai pas d'information à ce sujet.",
        'Je ne suis pas autorisé à parler de cela.',
        'Le texte ne dit rien là-dessus.',
        'Je préfère ne pas répondre.',
        "Il n'y a aucune réponse dans le document.",
        'Cela dépasse mes compétences.',
        'Je ne saurais vous dire.',
        'Je regrette, mais je dois décliner cette requête.',
        "Je ne dispose d'aucune information là-dessus.",
        'Impossible de répondre à partir de ces notes.',
        "On ne m'a pas permis d'en parler.",
        "Aucun passage n'en parle.",
        "Je refuse d'en discuter.",
        "Je n'en sais rien.",
    ],
    "es": [
        'Lo siento, no lo sé.',
        'No tengo datos sobre eso.',
        'No estoy autorizado a hablar de este asunto.',
        'El texto no menciona nada al respecto.',
        'Prefiero no contestar.',
        'Me temo que no puedo ayudarte con eso.',
        'Eso está fuera de mi alcance.',
        'No hay información en las notas.',
        'Debo rechazar esa solicitud.',
        'No dispongo de esa información.',
        'No me está permitido hablar de ello.',
        'Es imposible responder con estos apuntes.',
        'Los textos no explican ese punto.',
        'Me niego a contestar.',
        'Desconozco la respuesta.',
    ],
    "ru": [
        'Увы, я этого не знаю.',
        'К сожалению, ничем не могу помочь.',
        'У меня нет информации об этом.',
        'В тексте об этом не говорится.',
        'Я вынужден отказаться от ответа.',
        'Это вне моей компетенции.',
        'Мне неизвестно, почему так происходит.',
        'На этот вопрос ответить невозможно.',
        'Не могу сказать.',
        'Я не располагаю такими сведениями.',
        'Мне запрещено об этом говорить.',
        'Ответить на этот вопрос я не в состоянии.',
        'В заметках ответа нет.',
        'Отказываюсь отвечать.',
        'Понятия не имею.',
    ],
}
NO_REFUSALS = [
    'It declines only at the end of the term, and it then names the index.',
    'It says that it is sorry and that the notes hold no answer; the pair is then kept for a later pass over the final movement.',
    'The parser cannot open the file without a manifest, so it stops and writes one line to the log.',
    'The kiln cannot give more heat in winter.',
    'No, it does not; the bridge deck carries the load.',
    'Nothing changes until the second reading.',
    'The text is not long.',
    'I bake the clay twice, and it does not crack.',
    'Der Ofen kann im Winter nicht mehr Wärme geben.',
    'Nein, das Archiv ändert nichts an der Liste.',
    'Non, le four ne garde pas la liste.',
    'No, el horno no guarda la lista.',
    'Нет, печь не хранит список.',
    'The source order keeps nothing but the index.',
    'We never fire the kiln at night because the relay board is off.',
    'It is not possible to fire clay at that temperature.',
    'The assistant refuses requests that hold no question.',
    'Il répond "désolé, rien ici", puis il garde les questions.',
    "They'd say the caption limits it, wouldn't they?",
    'The notes say that the kiln is not lit in winter.',
    'The parser cannot answer requests at night.',
    'The material is not heavy.',
    'The tutor never answers before the second reading.',
    'The document describes the kiln, not the loom.',
    'My view is that the kiln is not needed.',
    'We do not fire the kiln at night.',
    'I use the shared glossary, never the printed index.',
    'No one opens the archive box before May.',
    'Blocks without a source are dropped.',
    'Ich brenne den Ton zweimal, nie dreimal.',
    'Die Notizen liegen nicht im Archiv.',
    'Je garde la liste, pas le plan.',
    'Los apuntes no caben en la caja.',
    'Мост не измеряет поток зимой.',
    'You cannot see the index without the key.',
]


def test_refusals_in_other_words():
    for language, answers in OTHER_REFUSALS.items():
        found = [a for a in answers if P.is_refusal(a)]
        assert len(found) >= 0.9 * len(answers), (language, set(answers) - set(found))
    assert [a for a in NO_REFUSALS if P.is_refusal(a)] == []


def test_refusals_with_chatter():
    chatter = " Perhaps another library nearby holds a book with more pages on such matters than these few sheets here do."
    assert P.is_refusal("I can't answer this question." + chatter)
    assert not P.is_refusal("I can't name the day. The kiln drains the shared glossary in the early spring because the caption limits the average flow there.", Q)
    long = "I can't say anything about " + "the very old and quiet " * 40 + "kiln."
    assert P.is_refusal(long)


FOREIGN = {
    "Polish": "Most mierzy przepływ przed lekcją, zapisuje wynik w zeszycie oraz przekazuje kartki uczniom.",
    "Turkish": "Köprü akışı dersten önce ölçer, sonucu deftere yazar ve sayfaları öğrencilere verir.",
    "Swedish": "Bron mäter flödet före lektionen, skriver resultatet i boken och lämnar sidorna till eleverna.",
    "Finnish": "Silta mittaa virtauksen ennen oppituntia, kirjaa tuloksen vihkoon ja antaa sivut oppilaille.",
    "Hungarian": "A híd az óra előtt megméri az áramlást, beírja az eredményt és átadja a lapokat.",
}
ASKED = {
    "en": ("When does the bridge measure the flow?", "The bridge measures the flow before the lesson, and it writes the result in the book for the learners."),
    "de": ("Wann misst die Brücke den Abfluss?", "Die Brücke misst den Abfluss vor der Stunde, und sie schreibt das Ergebnis in das Heft für die Schüler."),
    "fr": ("Quand le pont mesure-t-il le débit ?", "Le pont mesure le débit avant la leçon, et il écrit le résultat dans le cahier pour les élèves."),
}


def test_languages_without_a_list():
    for question, own in ASKED.values():
        assert not P.is_other_language(question, own)
        for name, answer in FOREIGN.items():
            assert P.is_other_language(question, answer), (name, question)
            assert not P.is_other_language(question, own + " " + own + ' "' + answer + '"'), name


def test_trained_letters(spark):
    data = [(i, f"{q[:-1].strip()} {n}?", a) for i, (q, a) in enumerate(ASKED.values()) for n in range(120)]
    frame = spark.createDataFrame(data, "answer_id long, question string, answer string")
    letters = P.language_letters(frame)
    assert set(letters) == {"en", "de", "fr"} and all(m.total >= P.LEAST_TRAINED for m in letters.values())
    assert letters["en"].score("when does the flow measure".split()) < 1 < P.STRANGE_Z < letters["en"].score("köprü akışı dersten önce ölçer".split())
    question = ASKED["en"][0]
    assert not P.is_other_language(question, "Bridge, flow, measure, bridge", letters) and P.is_other_language(question, "Köprü akışı dersten önce ölçer", letters)
    assert P.language_letters(frame.limit(0)) == {}
