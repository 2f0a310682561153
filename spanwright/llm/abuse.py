"""Abusive, hateful and sexual content by weak supervision.

Many lexicon and pattern voters judge each sentence, after spelling tricks are undone. A generative label model, fitted
by expectation maximisation on the counts of vote patterns over all sentences, estimates how accurate each voter is and
which voters agree more than their accuracies explain; correlated voters share their weight. Its posterior labels train
one linear classifier per category, which scores every sentence; a document's score is that of its worst sentence.

No voter knows the answer of another or of the model: each looks for one thing, alone or beside one other. The word lists
are general ones of four languages. Only vote-pattern counts (at most 3 to the number of voters, in practice tens) and the
bounded training sample reach the driver; both are stated parameters. Counts cover all sentences. Null and empty texts
score 0; markup and odd blanks are removed before reading; whole texts are read; repeated texts are each answered; empty
tables give empty results.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import emit, ship, spread, work_dir

CATEGORIES = ("abusive", "hateful", "sexual")
#: Training sentences at most for each kind: with some vote, different ones without any, and occurrences without any.
SAMPLE_VOTED, SAMPLE_SILENT, SAMPLE_USUAL = 20_000, 6_000, 3_000
#: Every voter is better than chance: its vote is at least so many times likelier where it is right.
LEAST = 3.0

# --- reading ----------------------------------------------------------------------------------------------------

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>|&[a-z]{2,6};|&#\d+;")
_SPLIT = re.compile(r"(?<=[.!?;])\s+|\n+")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_MIXED = re.compile(r"(?=\S*[a-z])(?=\S*[0134578@$€])[a-z0134578@$€]{3,}(?=\W|$)")
_SIGNS = re.compile(r"[0134578@$€]")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]([ .*_\-·]))(?:[^\W\d_]\1){1,}[^\W\d_](?![^\W_])")
_APART = re.compile(r"[^\W\d_][ .*_\-·][^\W\d_][ .*_\-·]")
_HIDDEN = re.compile("[\u0300-\u036f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_BLANKS, _THRICE, _NUMBER = re.compile(r"\s+"), re.compile(r"([a-z])\1{2,}"), re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "’": "'"})
_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")


def plain(sentence: str) -> str:
    """Lower case without accents, hidden characters, digits for letters, or letters set apart."""
    s = sentence.lower()
    if not s.isascii():
        s = _HIDDEN.sub("", unicodedata.normalize("NFKD", s.translate(_LETTERS)))
    s = _BLANKS.sub(" ", s)
    if _APART.search(s):
        s = _SPACED.sub(lambda m: re.sub(r"[ .*_\-·]", "", m.group(0)), s)
    if _SIGNS.search(s):
        s = _MIXED.sub(lambda m: m.group(0).translate(_LEET), s)
    return _THRICE.sub(r"\1", s)


def sentences(text: str | None) -> list[str]:
    if not text:
        return []
    # Spaces doubled throughout are an odd layout, not the end of anything.
    return [s for s in _SPLIT.split(_TAG.sub("\n", text) if "<" in text or "&" in text else text) if s and not s.isspace()]


# --- voters -----------------------------------------------------------------------------------------------------

#: General word lists in English, German, Spanish and French, without accents as plain() leaves them.
_LISTS = {
    "insult": r"idiot\w*|morons?|imbecil\w*|stupid|dumb|dumbass|fools?|losers?|scum|scumbags?|clowns?|halfwits?|nitwits?|dimwits?|jerks?|pathetic|worthless|useless|spineless|disgusting|ugly|lazy|trash|garbage|filth\w*|bastards?|cowards?|assholes?|arsehole|dickheads?|bitch\w*|whores?|sluts?|pigs?|rats?|cretins?|retard\w*|freaks?|failures?|disgrace|joke|nobody|parasites?|dumm\w*|versager\w*|trottel|niete|depp\w*|vollidiot\w*|blod\w*|erbarmlich\w*|wertlos\w*|nutzlos\w*|arschloch|schwein\w*|abschaum|feigling\w*|faul\w*|inutil\w*|idiotas?|tont[oa]s?|estupid[oa]s?|imbeciles?|basura|cobardes?|asqueros[oa]s?|patetic[oa]s?|gilipollas|cabron\w*|perdedor\w*|vag[oa]s?|payas[oa]s?|minables?|abruti\w*|cretine?s?|connards?|connasse|salaud\w*|nulle?s?|pauvre type|bon a rien|lache|ordure|debiles?|bouffons?|honte|waste of (?:space|air|time)|piece of \w+",
    "you": r"you|your|yours|you're|yourself|u|ur|du|dich|dir|dein\w*|euch|tu|te|toi|ton|ta|tes|t'es|vous|votre|vos|ti|tus|eres|usted|ustedes|contigo",
    "tell": r"shut (?:up|your)|get lost|drop dead|piss off|fuck off|screw you|go to hell|go away|get out of|crawl back|jump off|kill yourself|go die|nobody (?:likes|wants|needs) you|hate you|you make me sick|makes? me sick|ashamed of|should be ashamed|too stupid to|halt (?:die|den|deine?) (?:klappe|mund|maul|fresse)|halt's maul|verpiss\w*|hau ab|verschwinde\w*|scher dich|schnauze|callate|cierra (?:la|el) (?:boca|pico)|vete al|largate|vete a la|que asco|das asco|ferme[- ](?:la|ta)|ta gueule|va te faire|degage\w*|casse-toi|fous le camp|tu me degoutes",
    "threat": r"kill you|hurt you|hit you|beat you|slap you|punch you|smash (?:your|you)|break (?:your|you)|cut you|destroy you|burn your|find you|find out where you|hunt you|come for you|coming for you|get you for|make you (?:pay|suffer|regret)|you(?:'ll| will) (?:regret|pay|be sorry|suffer)|watch your back|you(?:'re| are) dead|ich (?:finde|kriege|schlage|bringe|erwische|mache) dich|dich (?:fertig|um|finden|kriegen|schlagen)|bereue\w*|dir eine|wirst (?:du )?bezahlen|te voy a|te vas a arrepentir|vas a (?:pagar|arrepentirte|sufrir)|te mato|te encontrare|paliza|je vais te|tu vas (?:le )?(?:regretter|payer|souffrir|voir)|je te (?:tue|retrouve|trouverai)|raclee|t'auras",
    "group": r"immigrants?|foreigners?|migrants?|refugees?|asylum seekers?|women|girls|females|disabled(?: people)?|homosexuals?|gays?|lesbians?|trans people|blacks?|whites?|asians?|arabs?|africans?|mexicans?|muslims?|jews?|jewish people|christians?|hindus?|atheists?|believers|unbelievers|gyps(?:y|ies)|roma|natives|old people|the poor|the homeless|(?:south|north|east|west)erners|auslander\w*|fluchtlinge\w*|migranten|einwanderer\w*|asylanten|frauen|behinderte\w*|schwule\w*|schwarze\w*|juden|muslime\w*|zigeuner\w*|turken|extranjer[oa]s|inmigrantes|migrantes|refugiad[oa]s|mujeres|discapacitad[oa]s|negr[oa]s|judi[oa]s|musulman\w*|gitan[oa]s|moros|gente del? \w+|etrangers?|immigres?|migrants|refugies?|femmes|handicapes?|noirs|arabes|juifs|musulmans?|gens (?:du|de|d')\s?\w+|leute aus \w+(?: \w+)?|people (?:from|of) (?:the )?\w+|those people|these people|such people|their kind|your kind|that kind|ihresgleichen",
    "dehuman": r"vermin|subhumans?|parasites?|filth\w*|scum|a disease|a plague|a cancer|animals|rats|cockroaches|insects|pests?|savages|inferior|dirt|pollut\w+|ungeziefer|abschaum|untermenschen|parasiten|tiere|ratten|minderwertig\w*|plaga|basura|escoria|alimanas|animales|ratas|parasitos|inferiores|vermine|dechets|racaille|sous-hommes|parasites|animaux|rats|nuisibles|inferieure?s|rot|infest\w*",
    "expel": r"throw\w* out|thrown out|kick\w* out|driven out|get rid of|got rid of|go back|back where they|back to where|send (?:them|all)|sent (?:back|home)|deport\w*|keep (?:\w+ ){0,3}(?:out|away)|away from|(?:do|does|did) ?n[o']t deserve|don't deserve|should not be allowed|never (?:hire|trust|let)|better without|once and for all|wiped? out|exterminat\w*|banned|no place|do not belong|don't belong|rausgeworfen|rauswerfen|raus|abschieben|verschwinden|gehoren nicht|verdienen (?:kein|nicht)\w*|ausrotten|echarl[oa]s|expuls\w+|fuera|deportar\w*|no merece\w*|eliminar\w*|largarse|chasse\w*|dehors|expulse\w*|renvoye\w*|virer|ne merite\w*|exterminer|interdi\w+",
    "kind": r"by nature|in their blood|in the blood|their nature|born (?:liars|thieves|criminals|stupid|lazy)|liars|thieves|criminals|rapists|terrorists|no brains?|too (?:stupid|dumb|lazy|weak)|all the same|every one of them|cannot (?:think|be trusted)|can't (?:think|be trusted)|only good for|good for nothing|belong in the|von natur aus|im blut|diebe\w*|lugner|verbrecher|kriminelle|zu (?:dumm|faul|schwach|blod)|alle gleich|taugen nicht\w*|por naturaleza|en la sangre|ladrones|mentirosos|criminales|delincuentes|no sirven|demasiado (?:tont|vag|debil)\w*|todos iguales|par nature|dans le sang|voleurs|menteurs|criminels|trop (?:bete|paresseu|faible|stupide)\w*|tous pareils|bons? a rien",
    "explicit": r"naked|nudes?|nudity|nackt\w*|desnud[ao]s?|nue?s?|a poil|sex\w*|sexo|sexe|horny|geil|porn\w*|breasts?|boobs|tits|ass|nipples?|penis|cock|dick|vagina|pussy|clit\w*|moan\w*|orgasm\w*|cum|undress\w*|without clothes|clothes off|take (?:it|everything|your \w+) off|strip(?:tease|per|ped)?|cam ?show|webcam|masturbat\w*|uncensored|unzensiert\w*|sin censura|ohne zensur|sans censure|(?:made|make|making) love|sleep with|in bed|bed with|coucher avec|hooker|escorts?|one-night|wild night|adults only|under her (?:skirt|dress|blouse)|skin|bare|naked body|lingerie|erotic\w*|erotik|erotique|erotico|fuck\w*|fick\w*|follar|baiser|blowjobs?|oral|anal|thrust\w*|kissed|tetas|culo|brust\w*|seins|caliente|xxx",
    "offer": r"send me|show me|give me|want to see|come (?:over|here|to my)|join (?:my|me)|i want (?:you|to)|i need you|i dream|keep dreaming|let's|tonight|all night|for (?:tips|cash|money|free)|message me|dm me|text me|call me|looking for|wait(?:ing)? for you|schick mir|zeig mir|komm (?:zu|vorbei)|ich will|heute nacht|ganze nacht|mandame|enviame|ensename|ven a|quiero|esta noche|toda la noche|envoie-moi|montre-moi|viens|je veux|ce soir|toute la nuit",
    "tech": r"process(?:es)?|workers?|replicas?|nodes?|threads?|cpu|gpu|memory|disk|cache|load|current|voltage|domains?|columns?|tables?|rows?|exports?|strings?|inputs?|outputs?|release|portal|rollback|roll(?:ed)? back|deploy\w*|pipeline|gateway|index|server|servers|kernel|daemon|script|query|queries|timeout|build|branch|commit|bug|api|endpoint|database|parser|regex|log|logs|job|jobs|queue|cluster|sensor|cable|wire|motor|pump|printer|scanner|software|firmware|update|feature|interface|dashboard|code|test|tests|penetration test\w*|test of|ticket|tickets|config\w*|vollast|server|abfrage|prozess\w*|proceso|servidor|consulta|processus|serveur|requete",
    "report": r"report\w*|policy|policies|filter\w*|block\w*|the word|words|term|terms|forbid\w*|prohibit\w*|harassment|speech|moderat\w*|complain\w*|training|education|course|definition|means|study|studies|survey|statistics|percent|law|court|police|victims?|abused|assault|discrimination|rights|equal\w*|same pay|paid the same|health|clinic|doctor|museum|painting|novel|film|article|history|awareness|prevention|gemeldet|meldung\w*|richtlinie\w*|belastigung|wort|studie|gesetz|polizei|denunci\w*|informe|politica|acoso|palabra|estudio|ley|policia|signale\w*|rapport|politique|harcelement|mot|etude|loi",
    "they": r"they|them|their|theirs|all of|sie|ihnen|ihre|alle|ellos|ellas|todos|todas|sus|ils|elles|eux|leurs?|tous|toutes",
    "me": r"me|my|mine|i|i'm|him|his|her|hers|he|she|ich|mir|mich|mein\w*|sie|er|ihr\w*|yo|mi|mis|conmigo|contigo|ella|el|je|moi|mon|ma|mes|elle|lui|toi",
}
_rx = {k: re.compile(rf"\b(?:{v})\b") for k, v in _LISTS.items()}
_QUOTED = re.compile(r"[\"“«„'][^\"”»“']{2,40}[\"”»“']")
#: Words that set an insult on a person, and an insult that closes a sentence as an address.
_SUCH = re.compile(rf"\b(?:such|what|only|just|so|total|absolute|bloody|fucking|little|espece d[e']|pauvre|sale|menudo|que|vaya|maldit[oa]|so ein\w*|du|ihr|verdammt\w*) (?:an? |ein\w* |une? |de |d')?(?:\w+ )?(?:{_LISTS['insult']})\b")
_CLOSING = re.compile(rf"(?:, |you |you're |du |tu |eres |t'es |an? )(?:\w+ ){{0,2}}(?:{_LISTS['insult']})\W*$")
#: A people is named by a capital and spoken of in the plural: "the Xs are", "alle X sind", "los X son", "les X sont".
_PEOPLE = re.compile(r"(?:^|\b(?:[Tt]he|[Aa]ll|[Tt]hose|[Tt]hese|[Ee]very|[Nn]o|[Ii]f|of|[Aa]lle|[Dd]ie|[Dd]iese|[Kk]eine|[Ll][oa]s|[Tt]odos l[oa]s|[Ee]sos|[Ll]es|[Tt]ous les|[Cc]es)\s+)[A-ZÀ-Þ][a-zß-ÿ]{3,}\s+(?:are|were|have|do|don't|should|must|belong|deserve|will|can|cannot|can't|never|always|sind|haben|gehören|sollten|sollen|verdienen|müssen|können|son|deben|deberían|tienen|merecen|no|nunca|siempre|sont|ont|doivent|devraient|méritent|ne|n'ont)\b")
_ANY = re.compile(rf"\b(?:{'|'.join(_LISTS[k] for k in ('insult', 'tell', 'threat', 'dehuman', 'expel', 'kind', 'explicit'))})\b")


def _near(s: str, a: str, b: str, within: int = 60) -> bool:
    """Whether something of list a stands within so many characters of something of list b, and is not the same words."""
    xs = [m.span() for m in _rx[a].finditer(s)]
    if not xs:
        return False
    return any((y.start() >= x[1] and y.start() - x[1] <= within) or (x[0] >= y.end() and x[0] - y.end() <= within) for y in _rx[b].finditer(s) for x in xs)


#: Voters of each category in the order of their votes; those named not_ vote against it, the others for it.
VOTERS = {
    "abusive": ("insult_you", "tell", "threat", "insult_such", "insult_closing", "insult_twice", "not_tech", "not_report", "not_quoted", "not_group", "not_you"),
    "hateful": ("group_dehuman", "group_expel", "group_kind", "group_insult", "people_dehuman", "people_expel", "people_kind", "they_dehuman", "they_kind", "not_report", "not_tech", "not_group"),
    "sexual": ("explicit", "explicit_offer", "explicit_you", "explicit_me", "explicit_two", "not_tech", "not_report", "not_quoted"),
}


def votes(sentence: str) -> dict[str, tuple[int, ...]] | None:
    """Votes (1 for, -1 against, 0 silent) of each category's voters, or None where all are silent."""
    s = plain(sentence)
    if not _ANY.search(s):
        return None
    has = {k: bool(_rx[k].search(s)) for k in ("insult", "you", "tell", "threat", "group", "dehuman", "expel", "kind", "explicit", "offer", "tech", "report")}
    quoted, people = bool(_QUOTED.search(sentence)), bool(_PEOPLE.search(sentence))
    ex = len(_rx["explicit"].findall(s)) if has["explicit"] else 0
    yes = lambda x: 1 if x else 0
    no = lambda x: -1 if x else 0
    return {
        "abusive": (yes(has["insult"] and _near(s, "insult", "you", 30)), yes(has["tell"]), yes(has["threat"]), yes(has["insult"] and _SUCH.search(s)), yes(has["insult"] and _CLOSING.search(s)), yes(has["insult"] and len(_rx["insult"].findall(s)) > 1), no(has["tech"]), no(has["report"]), no(quoted), no(has["group"] or people), no(not has["you"] and not has["tell"] and not _SUCH.search(s))),
        "hateful": (yes(_near(s, "group", "dehuman")), yes(_near(s, "group", "expel")), yes(_near(s, "group", "kind")), yes(_near(s, "group", "insult")), yes(people and has["dehuman"]), yes(people and has["expel"]), yes(people and has["kind"]), yes(_near(s, "they", "dehuman", 30)), yes(_near(s, "they", "kind", 30)), no(has["report"]), no(has["tech"]), no(not has["group"] and not people)),
        "sexual": (yes(ex), yes(ex and _near(s, "explicit", "offer", 40)), yes(ex and _near(s, "explicit", "you", 30)), yes(ex and _near(s, "explicit", "me", 30)), yes(ex > 1), no(has["tech"]), no(has["report"]), no(quoted)),
    }


# --- the label model --------------------------------------------------------------------------------------------


class LabelModel:
    """Latent label with a prior; each voter's chance of each vote given the label; correlated voters share weight."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, for_it: list[bool] | None = None, least: float = 1.0, prior: float = 0.3, rounds: int = 60):
        v, n = np.asarray(patterns, int), np.asarray(counts, float)
        m = v.shape[1]
        hot = np.stack([(v == k) for k in (-1, 0, 1)], 2).astype(float)  # [pattern, voter, vote]
        for_it = (v > 0).any(0) if for_it is None else for_it
        # A voter that votes for the category does so mostly where it holds, one against it mostly where it doesn't.
        self.table = np.empty((2, m, 3))
        for j in range(m):
            self.table[1, j] = (0.02, 0.38, 0.60) if for_it[j] else (0.08, 0.90, 0.02)
            self.table[0, j] = (0.02, 0.78, 0.20) if for_it[j] else (0.55, 0.43, 0.02)
        self.prior, self.weight = prior, np.ones(m)
        base = self.table.copy()
        strength = 0.02 * n.sum() + 5
        for step in range(rounds):
            q = self.posterior(v)
            self.prior = float(np.clip((n * q).sum() / max(n.sum(), 1), 0.02, 0.9))
            for y, w in ((1, n * q), (0, n * (1 - q))):
                c = np.einsum("p,pjk->jk", w, hot) + strength * base[y]
                self.table[y] = c / c.sum(1, keepdims=True)
            for j, f in enumerate(for_it):
                right, wrong, vote = (1, 0, 2) if f else (0, 1, 0)
                most = self.table[right, j, vote] / least
                if self.table[wrong, j, vote] > most:
                    rest = 1 - self.table[wrong, j, vote]
                    self.table[wrong, j] *= (1 - most) / max(rest, 1e-9)
                    self.table[wrong, j, vote] = most
            if step == rounds // 2:
                self.correlate(v, n, q)

    def correlate(self, v: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        """Correlation of voters that their accuracies leave unexplained; each voter's weight is shared among its like."""
        expect = np.stack([self.table[y, :, 2] - self.table[y, :, 0] for y in (0, 1)])
        left = v - ((1 - q)[:, None] * expect[0] + q[:, None] * expect[1])
        cov = (left * n[:, None]).T @ left / max(n.sum(), 1)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        self.correlation = cov / d[:, None] / d
        excess = np.clip(self.correlation - 0.1, 0, 1)
        np.fill_diagonal(excess, 0)
        self.weight = 1 / (1 + excess.sum(1))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        idx = np.asarray(v, int) + 1
        rows = np.arange(idx.shape[1])
        like = np.stack([(np.log(self.table[y][rows, idx]) * self.weight).sum(1) for y in (0, 1)])
        z = like[1] - like[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-z))


# --- the classifier ---------------------------------------------------------------------------------------------


def features(sentence: str) -> list[str]:
    """Words, word pairs and word beginnings of a sentence; numbers and model names are left out."""
    w = ["^", *_WORD.findall(plain(sentence)), "$"]
    out = set(w[1:-1])
    out.update(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
    out.update(x[:5] + "*" for x in w[1:-1] if len(x) > 5)
    return sorted(out)


def train_linear(rows: list[list[str]], target: np.ndarray, weight: np.ndarray, rounds: int = 60, l2: float = 1e-4, least: int = 1) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Logistic weights of each feature for each category from posterior labels; full batch with adaptive steps."""
    seen: dict[str, int] = {}
    for r in rows:
        for f in r:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    ptr, col = [0], []
    for r in rows:
        col += [index[f] for f in r if f in index]
        ptr.append(len(col))
    k = target.shape[1]
    w, b = np.zeros((len(index), k)), np.full(k, -2.0)
    col_a, ptr_a = np.array(col, np.int64), np.array(ptr)
    n = np.diff(ptr_a)
    scale = 1 / np.sqrt(np.maximum(n, 1))
    row_a = np.repeat(np.arange(len(rows)), n)
    by_col = np.argsort(col_a, kind="stable")
    full, heads = n > 0, ptr_a[:-1][n > 0]
    cols = np.searchsorted(col_a[by_col], np.arange(len(index)))
    rows_by_col, share = row_a[by_col], weight[:, None] / max(weight.sum(), 1)
    g2, gb2 = np.full_like(w, 1e-8), np.full(k, 1e-8)
    z = np.zeros((len(rows), k))
    for _ in range(rounds * 4):
        if len(heads):
            z[full] = np.add.reduceat(w[col_a], heads, axis=0)
        e = (1 / (1 + np.exp(-(z * scale[:, None] + b))) - target) * share
        g = np.add.reduceat((e * scale[:, None])[rows_by_col], cols, axis=0) + l2 * w / max(1, len(rows)) if len(cols) else np.zeros_like(w)
        gb = e.sum(0)
        g2 = 0.95 * g2 + 0.05 * g * g
        gb2 = 0.95 * gb2 + 0.05 * gb * gb
        w -= 0.08 * g / np.sqrt(g2)
        b -= 0.08 * gb / np.sqrt(gb2)
    keep = np.abs(w).max(1, initial=0) > 0.02
    return {f: w[i] for f, i in index.items() if keep[i]}, b


def _vote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences with votes; of the others the least hashes, of sentences and of occurrences, as many as are sampled.

    A sentence among the least hashes of all is among the least of every task that has it, so its number is exact.
    """
    known: dict[str, str] = {}
    voted: dict[tuple[str, str], int] = {}
    kept: dict[str, list[int]] = {}
    order: list[tuple[int, str]] = []
    usual: list[tuple[int, str]] = []
    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            for at, s in enumerate(sentences(text if isinstance(text, str) else None)):
                key = _NUMBER.sub("0", s)
                p = known.get(key)
                if p is None:
                    v = votes(s)
                    p = "" if v is None else ",".join(str(x) for c in CATEGORIES for x in v[c])
                    if len(known) > 200_000:
                        known.clear()
                    known[key] = p
                if p:
                    voted[key, p] = voted.get((key, p), 0) + 1
                    continue
                if key in kept:
                    kept[key][0] += 1
                else:
                    h = xxhash.xxh64_intdigest(key)
                    if len(order) < SAMPLE_SILENT or h < -order[0][0]:
                        kept[key] = [1]
                        heapq.heappush(order, (-h, key))
                        if len(order) > SAMPLE_SILENT:
                            del kept[heapq.heappop(order)[1]]
                h = xxhash.xxh64_intdigest(f"{doc} {at}")
                if len(usual) < SAMPLE_USUAL:
                    heapq.heappush(usual, (-h, key))
                elif h < -usual[0][0]:
                    heapq.heapreplace(usual, (-h, key))
    signed = lambda h: h - (1 << 63)
    rows = [(s, p, n, 0, "voted") for (s, p), n in voted.items()] + [(s, "", kept[s][0], signed(-h), "silent") for h, s in order] + [(s, "", 1, signed(-h), "usual") for h, s in usual]
    yield from emit(pd.DataFrame(rows, columns=["sentence", "pattern", "n", "rank", "kind"]))


def fit(documents: DataFrame) -> dict:
    """The label models and the classifier, from all documents' sentences."""
    spark = documents.sparkSession
    ship(spark)
    path = work_dir(spark, "votes")
    spread(documents.select("doc_id", "text")).mapInPandas(_vote_rows, "sentence string, pattern string, n bigint, rank bigint, kind string").write.parquet(path)
    made = spark.read.parquet(path)
    voted = made.where("kind = 'voted'")
    width = [len(VOTERS[c]) for c in CATEGORIES]
    cut = np.cumsum([0, *width])
    parse = lambda p: np.array(p.split(","), int)
    models = []
    for k, c in enumerate(CATEGORIES):
        # Patterns of one category where any voter speaks for it: at most 3 to the number of its voters.
        own = F.slice(F.split("pattern", ","), int(cut[k]) + 1, width[k])
        rows = voted.where(F.exists(own, lambda x: x == "1")).groupBy(F.array_join(own, ",").alias("p")).agg(F.sum("n").alias("n")).orderBy("p").collect()
        models.append(LabelModel(np.array([parse(r["p"]) for r in rows]), np.array([r["n"] for r in rows], float), [not v.startswith("not_") for v in VOTERS[c]], LEAST) if rows else None)
    some = voted.groupBy("sentence", "pattern").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("sentence"), "sentence").limit(SAMPLE_VOTED)
    silent = made.where("kind = 'silent'").groupBy("rank", "sentence", "pattern").agg(F.sum("n").alias("n")).orderBy("rank").limit(SAMPLE_SILENT).drop("rank")
    usual = made.where("kind = 'usual'").select("rank", "sentence", "pattern", "n").orderBy("rank").limit(SAMPLE_USUAL).drop("rank")
    sample = [r for part in (some, silent, usual) for r in part.select("sentence", "pattern", "n").collect()]
    target = np.zeros((len(sample), 3))
    for i, r in enumerate(sample):
        if r["pattern"]:
            v = parse(r["pattern"])
            for k in range(3):
                own = v[cut[k] : cut[k + 1]]
                if models[k] is not None and (own > 0).any():
                    target[i, k] = models[k].posterior(own[None])[0]
    weight = np.array([1.0 + np.log1p(r["n"]) for r in sample]) if sample else np.zeros(0)
    weights, bias = train_linear([features(r["sentence"]) for r in sample], target, weight) if sample else ({}, np.full(3, -9.0))
    return {"models": models, "weights": weights, "bias": bias, "sample": len(sample)}


def _score(weights: dict[str, np.ndarray], bias: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = np.zeros((len(pdf), 3))
            for i, text in enumerate(pdf["text"]):
                for s in sentences(text if isinstance(text, str) else None):
                    key = _NUMBER.sub("0", s)
                    p = memo.get(key)
                    if p is None:
                        fs = features(s)
                        z = bias.copy()
                        if fs:
                            hit = [weights[f] for f in fs if f in weights]
                            if hit:
                                z = z + np.sum(hit, 0) / np.sqrt(len(fs))
                        p = 1 / (1 + np.exp(-z))
                        if len(memo) < 200_000:
                            memo[key] = p
                    np.maximum(out[i], p, out=out[i])
            yield from emit(pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], **{c: out[:, k] for k, c in enumerate(CATEGORIES)}}))

    return run


def score(documents: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): each document's scores from 0 to 1."""
    model = model or fit(documents)
    src = spread(documents.select("doc_id", "source", "text"))
    return src.mapInPandas(_score(model["weights"], model["bias"]), "doc_id bigint, source string, abusive double, hateful double, sexual double")


def flagged(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, category) of each category a document contains."""
    return scores.select("doc_id", F.explode(F.filter(F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES]), lambda c: c.isNotNull())).alias("category"))


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents and share of each category per source."""
    return scores.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("docs"), *[F.round(F.avg((F.col(c) >= threshold).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES])
