"""Defective prompt and answer pairs: empty, truncated, refusing, copying or in a wrong language.

Copies are found by aligning the tokens of prompt and answer: containment of word shingles first, then the longest common
subsequence. Refusals are found by aligning every sentence of the answer, whatever its length, with templates of
slots; one after the first counts where no other sentence carries an answer. Truncation comes from the
trigram statistics of cut_texts. A row has at most one defect, the first that holds in the order of DEFECTS.

Defined cases: a null answer counts as empty; a null or empty prompt can neither be copied nor fix a language; texts of
any length are aligned whole, by shingle first; repeated rows are each answered; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import emit, ship

DEFECTS = ("empty_answer", "truncated_answer", "refusal", "copied_question", "wrong_language")

#: Stand-ins for "no value" beside blanks and punctuation.
_STAND_INS = {"na", "n a", "null", "none", "nil", "nan", "empty", "no output", "no answer", "no response", "no value", "undefined", "missing", "blank", "nothing", "keine antwort", "sin respuesta", "pas de réponse", "aucune réponse", "keine", "ninguna", "vacío", "leer", "vide"}

#: How refusals are worded, by slots: words of one slot are alternatives, and few words may stand between two slots.
_REFUSALS = """
i we i'm we're i'll i'd|can't cannot couldn't won't not unable never|help assist answer reply respond share provide give discuss talk speak comment comply disclose reveal say tell fulfil fulfill offer support continue proceed engage supply release
i we i'm we're|not|allowed permitted authorised authorized comfortable able free willing|answer answering share sharing help say saying discuss discussing give giving provide providing talk talking disclose disclosing reply reveal tell respond comment
i we i'm we're i'll|decline refuse declining refusing refrain abstain
i we i'd we'd i'll|rather prefer choose|not|answer say discuss share comment respond reply help talk give tell disclose
i we i'll|pass skip|on|this that question request one
my our|guidelines policy policies instructions rules principles programming settings|forbid forbids prohibit prohibits prevent prevents disallow exclude not don't
against violate violates outside beyond breach contrary|my our|guidelines policy policies instructions rules principles scope remit role
that this such these it|off confidential restricted|limits limit me information details
that this it it's|isn't not|something anything|i we
not isn't wouldn't|appropriate right proper permitted possible|me us|answer respond discuss share say help reply comment
request question information details inquiry this that|cannot can't not won't|be|answered fulfilled fulfilled provided shared disclosed processed given discussed released
no nothing|answer reply comment information response details|will can may be from|given provided available me us possible
nothing|i we|allowed permitted can may able|say share tell add disclose
ich wir|nicht keine kein|helfen antworten beantworten sagen geben weitergeben mitteilen nennen erteilen unterstützen besprechen diskutieren machen äußern verraten teilen
kann können darf dürfen möchte möchten werde werden|ich wir|nicht keine kein|helfen antworten beantworten sagen geben weitergeben mitteilen nennen erteilen unterstützen besprechen verraten teilen reden sprechen äußern
ich wir|lehne lehnen verweigere verweigern enthalte muss müssen|ab antwort auskunft ablehnen verweigern
frage anfrage auskunft information angaben darüber das|nicht keine|erlaubt gestattet zulässig möglich beantwortet erteilt vorgesehen gegeben
no|puedo podemos quiero queremos voy vamos debo debemos deseo puede|ayudar ayudarle ayudarte ayudarlo responder contestar decir decirle dar darle proporcionar compartir revelar hablar facilitar comentar atender tratar ofrecer
no|me nos estoy estamos está se tengo|permitido permite autorizado autorizada autorizados permiso puede|responder contestar decir dar proporcionar compartir revelar hablar facilitar comentar contarlo
prefiero preferimos preferiría|no|responder contestar decir decirlo hablar dar compartir comentar opinar
rechazo rechazamos declino niego negarme rehúso abstengo|responder contestar solicitud petición pregunta hacerlo
je nous|ne n'ai n'avons|peux pouvons suis sommes veux souhaite puis droit pas|pas en droit|aider répondre dire donner fournir partager révéler parler communiquer divulguer commenter traiter d'en autorisé autorisée mesure aborder
je nous|préfère préférons préférerais|ne|pas|répondre dire parler donner partager commenter prononcer
je nous|refuse refusons décline déclinons dois abstiens|répondre demande question refuser décliner de
"""
_TEMPLATES = [[frozenset(slot.split()) for slot in line.split("|")] for line in _REFUSALS.strip().splitlines()]
#: Words that may stand between two slots of a refusal.
_GAP = 4
#: Sentences that carry no answer, whole: thanks, greetings, apologies.
_COURTESY = re.compile(
    r"(?:(?:many )?thanks|thank you)(?: (?:so|very) much)?(?: (?:for|again)(?: \w+){0,4})?|hello|hi|hi there|hello there|good (?:morning|afternoon|evening)|hmm|unfortunately|(?:i'm |i am |we're |we are )?(?:very |so |really |terribly )?sorry(?: (?:for|about)(?: \w+){1,4})?|i apologi[sz]e(?: for(?: \w+){1,4})?|(?:my|our) apologies|i understand(?: (?:your|the) \w+)?|(?:that's |that is )?(?:a )?(?:good|great) question"
    r"|(?:vielen )?(?:dank|danke)(?: für(?: \w+){1,3})?|hallo|guten (?:tag|morgen|abend)|leider|(?:es )?tut mir (?:sehr )?leid|entschuldigung"
    r"|(?:muchas )?gracias(?: por(?: \w+){1,3})?|hola|buenos días|buenas tardes|lo siento(?: mucho)?|lamentablemente"
    r"|merci(?: beaucoup)?(?: (?:pour|de)(?: \w+){1,3})?|bonjour|bonsoir|(?:je suis )?(?:vraiment )?désolée?|malheureusement"
)

#: Articles, pronouns, prepositions, conjunctions and auxiliary verbs: the words a text of any content is tied together by.
_LANG = {
    "en": "the of and to in is are was were for with that this these those it its at on by from have has had be been being not no which what when where who how many does do did you your they their them will would can could must should each one into after before an a than as or but if there here we our us he she his her i my me so up out about over under between during without only also some any more most other such then".split(),
    "de": "der die das den dem des und ist sind war waren wird werden wurde wurden nicht mit von vom im in am an zu zum zur auf für aus bei nach wie viele viel welche welcher welches welchem welchen ein eine einen einem einer eines hat haben hatte dort auch sich über unter vor durch gegen ohne um oder aber wenn als dass es er sie wir ihr ich mein sein kann können muss müssen soll darf noch nur schon man bis seit während zwischen kein keine was wer wo wann".split(),
    "es": "el la los las lo del de y e es son fue era fueron ser en con por para que se un una unos unas al como más qué quién cuál cuándo cuántos cuántas cuánto dónde no sin su sus le les nos me te mi tu este esta estos estas ese esa eso está están estaba hay ha han había tiene tienen puede pueden debe deben pero o si ya muy también sobre entre desde hasta hacia cuando donde porque cada todo todos antes después".split(),
    "fr": "le la les du des de et est sont était étaient été être en dans avec par pour que qui quoi quel quelle quels quelles une un au aux se ne pas plus combien son sa ses leur leurs mon ma mes ce cet cette ces il elle ils elles on nous vous je tu y où quand comment mais ou donc si comme sur sous entre sans chez depuis pendant après avant jusqu a ont avait peut peuvent doit doivent fait très aussi chaque tout tous".split(),
    "it": "il lo la i gli le un una uno di del dello della dei degli delle e è sono era erano in nel nella con per da dal dalla che chi si non più come quando dove quanto quanti quale quali al alla ai alle su sul sulla questo questa questi queste ha hanno può possono deve ma o se anche ogni tra fra prima dopo".split(),
    "pt": "o a os as um uma de do da dos das e é são foi era em no na nos nas com por para que se não mais como quando onde quanto quantos qual quais ao à aos às este esta isso ele ela eles você tem têm pode podem deve mas ou também cada entre antes depois até".split(),
    "nl": "de het een en is zijn was waren van in op te dat die dit met voor aan bij uit naar om niet geen ook als maar of er wordt worden werd heeft hebben had kan kunnen moet moeten zal hoe veel hoeveel welke wat wie waar wanneer wij we hij ze ik je nog over onder tussen na tot door".split(),
}
_VOTES: dict[str, list[str]] = {}
for _l, _ws in _LANG.items():
    for _w in _ws:
        _VOTES.setdefault(_w, []).append(_l)
#: Letters and endings of words that speak for a language.
_HINTS = (
    (re.compile(r"[äöüß]|\w(?:ung|ungen|lich|keit|heit|schaft)\b"), "de"),
    (re.compile(r"[¿¡ñ]|\w[áíóú]|\w(?:ción|ciones|miento|idad|aron|ieron)\b"), "es"),
    (re.compile(r"[âçèêëîïôœû]|\w(?:eux|euse|ement|ité|aient)\b"), "fr"),
    (re.compile(r"\b(?:[ldcsnj]|qu)['’][a-zéèêàôœ]"), "fr"),
    (re.compile(r"\w(?:ing|ness|ly|ight|ould)\b|\w'(?:s|re|ve|ll)\b"), "en"),
    (re.compile(r"\w(?:zione|zioni|mente|ità)\b"), "it"),
    (re.compile(r"[ãõ]|\w(?:ção|ções|dade)\b"), "pt"),
    (re.compile(r"ij|\w(?:heid|lijk)\b"), "nl"),
)
_NAMES = {
    "en": "english englisch inglés anglais inglese inglês engels".split(), "de": "german deutsch alemán allemand tedesco alemão duits".split(), "es": "spanish spanisch español castellano espagnol spagnolo espanhol spaans".split(), "fr": "french französisch francés français francese francês frans".split(),
    "it": "italian italienisch italiano italien italiaans".split(), "pt": "portuguese portugiesisch portugués portugais portoghese português".split(), "nl": "dutch niederländisch holandés neerlandés néerlandais olandese nederlands".split(),
}
_NAMES = {w: k for k, ws in _NAMES.items() for w in ws}
#: A language a prompt names behind a preposition: "in French", "auf Deutsch", "en español".
_ASKED = re.compile(r"\b(?:in|into|auf|ins|en|em|op|to)\s+(" + "|".join(_NAMES) + r")\b", re.I)

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LEAD = re.compile(r"^\s*(?:you asked|question|frage|pregunta|your question|the question was|q|prompt|user)\s*[:\-–]\s*", re.I)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFC", text).lower().replace("’", "'"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows: len(b) steps on integers of len(a) bits."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def containment(inner: list[str], outer: list[str], k: int = 3) -> float:
    """Share of the word k-shingles of inner that outer has; shorter texts are one shingle."""
    k = min(k, len(inner))
    if not k:
        return 0.0
    have = {tuple(outer[i : i + k]) for i in range(len(outer) - k + 1)}
    own = [tuple(inner[i : i + k]) for i in range(len(inner) - k + 1)]
    return sum(s in have for s in own) / len(own)


def language(text: str) -> str | None:
    """The language of a text by its function words, letters and endings, or None if the text doesn't say."""
    score = dict.fromkeys(_LANG, 0.0)
    words = tokens(text)
    for w in words:
        ls = _VOTES.get(w)
        if ls:
            for x in ls:
                score[x] += 1 / len(ls)
    low = text.lower()
    for rx, x in _HINTS:
        if n := len(rx.findall(low)):
            score[x] += min(1.5, 0.5 * n)
    (first, a), (_, b) = sorted(score.items(), key=lambda kv: -kv[1])[:2]
    return first if len(words) >= 3 and a >= 1.5 and a >= 1.4 * b + 0.5 else None


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    words = " ".join(_TOKEN.findall(answer.lower()))
    return not words or words in _STAND_INS


def is_refusal(answer: str, question: str = "") -> bool:
    """Whether the first sentence refuses, or any other one does and none carries an answer."""
    said = [x for x in re.split(r"(?<=[.!?])\s|\n", answer.strip()) if tokens(x)]
    no = [refuses(x) for x in said]
    return bool(no) and (no[0] or (any(no) and not any(carries_answer(x, question) for x, r in zip(said, no, strict=True) if not r)))


def carries_answer(sentence: str, question: str) -> bool:
    """Whether a sentence has a number, is as short as a bare value, or takes up a word of the question."""
    w = tokens(sentence)
    if _COURTESY.fullmatch(" ".join(w)):
        return False
    asked = {x for x in tokens(question) if len(x) > 3 and x not in _VOTES}
    return len(w) <= 3 or any(c.isdigit() for c in sentence) or not asked.isdisjoint(w)


def aligned(words: list[str], template: list[frozenset[str]]) -> bool:
    """Whether the words have one of each slot in order, with at most _GAP words between two slots."""
    ends = [i for i, w in enumerate(words) if w in template[0]]
    for slot in template[1:]:
        ends = sorted({j for i in ends for j in range(i + 1, min(len(words), i + 2 + _GAP)) if words[j] in slot})
        if not ends:
            return False
    return bool(ends)


def refuses(sentence: str) -> bool:
    """Whether a sentence aligns with a refusal and gives no figure."""
    return not any(c.isdigit() for c in sentence) and any(aligned(w, t) for w in (tokens(sentence),) for t in _TEMPLATES)


def question_of(question: str | None, prompt: str | None) -> str:
    if question and question.strip():
        return question
    if not prompt:
        return ""
    asked = [m.group(0) for m in re.finditer(r"[^.?!\n¿]*\?", prompt)]
    return max(asked, key=len) if asked else prompt


def is_copy(question: str, prompt: str, answer: str) -> bool:
    body = _LEAD.sub("", answer)
    a, q, p = tokens(body), tokens(question), tokens(prompt or "")
    if len(a) < 3 or len(q) < 3:
        return False
    inside = containment(a, p or q)
    if inside < 0.6 and containment(q, a) < 0.6:
        return False
    if lcs(q, a) < 0.8 * len(q):
        # A piece of the prompt without its question, or of the question alone.
        return len(a) >= 5 and containment(a, q) >= 0.9
    rest = list(a)
    # Takes away each copy of the question; what is left must be the prompt's own words.
    while len(rest) >= len(q) * 0.7 and lcs(q, rest[: len(q)]) >= 0.75 * len(q):
        rest = rest[len(q) :]
    if len(rest) <= 2:
        return True
    return inside >= 0.9 and containment(rest, p) >= 0.9


def defect(question: str | None, prompt: str | None, answer: str | None, cut: bool) -> str | None:
    """The defect of one pair, or None."""
    if is_empty(answer):
        return DEFECTS[0]
    if cut:
        return DEFECTS[1]
    q = question_of(question, prompt)
    if is_refusal(answer, q):
        return DEFECTS[2]
    if q and is_copy(q, prompt or q, answer):
        return DEFECTS[3]
    # A repeated question says nothing of the answer's language.
    said = language(answer.replace(q.strip(), " ") if q.strip() else answer)
    if said and (prompt or q):
        wanted = language(q) or language(prompt or "")
        asked = {_NAMES[m.lower()] for m in _ASKED.findall(prompt or "")}
        if wanted and said != wanted and said not in asked:
            return DEFECTS[4]
    return None


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    text = lambda x: x if isinstance(x, str) else None
    for pdf in batches:
        got = [defect(text(q), text(p), text(a), bool(c)) for q, p, a, c in zip(pdf["question"], pdf["prompt"], pdf["answer"], pdf["cut"], strict=True)]
        yield from emit(pd.DataFrame({"row_no": pdf["row_no"], "defect": got}))


def broken_pairs(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (row_no, defect) of pairs (row_no, question, prompt, answer); cut holds the row_no of truncated answers."""
    ship(pairs.sparkSession)
    known = cut.select("row_no").distinct().withColumn("cut", F.lit(True))
    src = pairs.select("row_no", "question", "prompt", "answer").join(known, "row_no", "left").select("row_no", "question", "prompt", "answer", F.coalesce("cut", F.lit(False)).alias("cut"))
    return src.mapInPandas(_flag, "row_no bigint, defect string").where(F.col("defect").isNotNull())
