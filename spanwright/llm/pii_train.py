"""Trains the character tagger from labelled spans: python -m spanwright.llm.pii_train OUT.npz [MINUTES [WORKERS [TOKENIZERS [LOCALES [START.npz]]]]].

The labelled texts are composed here by rule and come from no data set: names, addresses, numbers and mailboxes are built
from public conventions of several countries and set behind general cues or among other words; numbers, titles and places
that are no personal data stand beside them. The other words are drawn from the vocabulary files of public tokenizers, from
the docstrings of Python's standard library and, where LOCALES names a folder of message catalogues, from the German,
French and Spanish messages of the programs installed there. Each worker composes batches of its own and sends gradients;
one process averages them.
"""

from __future__ import annotations

import ast
import base64
import gettext
import multiprocessing
import os
import random
import re
import sys
import time
from pathlib import Path

import numpy as np

from .chartag import LABELS, TYPES, Tagger, encode, init_params, loss_and_grads, spans_of

TOKENIZERS, LOCALES = "/opt/tokenizers", "/root/miniconda/share/locale"

_FIRST = (
    "James Robert Patricia Linda William Barbara Richard Susan Thomas Karen Daniel Nancy Matthew Emily George Alice Henry Grace Oliver Chloe Jack Ella Liam Hannah Sean Niamh Rhys Megan "
    "Hans Ulrike Klaus Sabine Jürgen Heike Stefan Monika Günther Petra Matthias Birgit Florian Katrin Sven Anke Pierre Camille Jean François Chantal Thierry Sylvie Mathieu Élodie Benoît Hélène Gaël Océane "
    "Carlos María Javier Lucía Pablo Carmen Andrés Pilar Íñigo Begoña Álvaro Ximena Giovanni Chiara Matteo Francesca João Beatriz Tiago Inês Jan Agnieszka Piotr Małgorzata Zbigniew Ivan Olga Sergei Tatiana Milan Jelena "
    "Lars Ingrid Magnus Astrid Åke Mikko Aino Dimitris Eleni Mehmet Ayşe Emre Ahmed Fatima Khalid Zainab Raj Anjali Vikram Lakshmi Wei Mei Hiroshi Yuki Min Ji Nguyen Thi Kofi Abena Chinedu Ngozi Thabo Sipho Tomás Ewa Bo Ian Zoe Lea Max Eva "
    "Anna Laura Julia Sarah Lisa Maria Sophie Nora Ruth Martha Helen Alan Brian Kevin Paul Peter Simon Stephen Andrew David Michael John Joseph Edward Frank Ralph Victor Hugo Felix Otto Emil Karl Ludwig Heinrich Wilhelm Johann Greta Ilse Hilde Erika Monique Claude Louis Marcel René Antoine Luc Noël Colette Rafael Diego Luis Jorge Pedro Ana Rosa Elena Isabel Teresa Leon Nadia Leila Omar Yusuf Amara Priya Sanjay Kenji Pavel Igor Nils Björn Søren"
).split()
_LAST = (
    "Smith Jones Taylor Brown Wilson Evans Walker Wright Thompson Hughes Edwards Green Hall Clarke Turner Murphy O'Brien O'Connor McCarthy MacDonald Campbell Stewart Fraser Baker Cooper Fletcher Mason Potter Shepherd "
    "Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Richter Schröder Neumann Zimmermann Vogel Kaiser Fuchs Lang Peters Krüger Dupont Martin Bernard Dubois Moreau Laurent Lefèvre Fournier Girard Mercier Lambert Fontaine Chevalier Garnier "
    "García Fernández González Rodríguez López Sánchez Pérez Gómez Díaz Muñoz Álvarez Romero Navarro Torres Ramírez Castillo Ortega Rossi Russo Ferrari Esposito Bianchi Silva Santos Oliveira Pereira Kowalski Nowak Wiśniewski Wójcik Lewandowski Ivanov Petrov Volkov Jovanović Nikolić "
    "Andersson Johansson Hansen Olsen Nielsen Virtanen Korhonen Papadopoulos Yılmaz Demir Khan Hussain Rahman Patel Sharma Singh Gupta Reddy Chen Wang Zhang Tanaka Suzuki Yamamoto Kim Park Tran Pham Okafor Mensah Dlamini Nkosi Cohen Levy Haddad Nasser"
).split()
_HEADS = "al an ar ba be bel ber bor bra bre bri bro cal car cas cor dal dar del dor dra el er fal far fen fin for gal gar gil gor gra hal har hel her hol hor jan jar kal kar kel kor kra lam lan lar lin lor mal mar mel mer mor nar nel nor ol or os pal par pel per pol ras rei ren ros sal san sel sen sil sol sor ste sto stra tal tam tar tel tor tra ul ur val van var vel ver vil vol wal war wel wen wil wol yor zan zel zor".split()
_TAILS = "son sen ski ska ova ev in ic ez es mann er ner ler ini ello etti escu ian yan ak uk ek berg stein feld ström qvist gren lund ton ley ford wood field ham worth well more low ier eau ard ault ot inen la nen ou is os ides i a o as us ulis ura oto awa moto".split()
_PLACE_TAILS = "ton ford ham ley dale by wick mouth field burg stadt hausen bach tal ingen ville court mont sur ac bourg rio mar villa ona ada ejo".split()
_TREES = "Oak Elm Maple Cherry Chestnut Park Church Mill School High Main Bridge River Lake Hill King Queen Victoria Market Castle Garden Spring Forest Meadow North South West East Linden Birken Garten Berg Wald Wiesen Haupt Kirch Bahnhof Schul Dorf Ring Rosen Buchen Goethe Schiller Mozart".split()
_WAYS = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Place Pl Square Sq Close Crescent Terrace Way Row Grove Gardens Hill Walk Boulevard Blvd Parkway Circle Mews Green".split()
_DE_WAYS = "straße strasse str. weg gasse allee platz ring damm ufer stieg".split()
_FR_WAYS = "rue de la|rue des|rue du|rue|avenue de|avenue|boulevard|place de la|place|chemin des|impasse|allée des|quai|route de".split("|")
_ES_WAYS = "Calle|calle|C/|Avenida|Avda.|Av. de|Plaza|Paseo de|Camino|Calle de la|Ronda".split("|")
_HOSTS = "gmail googlemail outlook hotmail yahoo icloud protonmail gmx web t-online freenet orange laposte wanadoo telefonica terra live aol fastmail mailbox posteo zoho".split()
_TLDS = "com com com org net de fr es co.uk io eu info edu example test invalid dev us ca com.au ch at it nl pl se co me gov uk.example org.example net.example com.example".split()

_TITLES = "Mr|Mrs|Ms|Mr.|Mrs.|Ms.|Miss|Dr.|Dr|Prof.|Sir|Herr|Frau|Herrn|Monsieur|Madame|M.|Mme|Mlle|Señor|Señora|Sr.|Sra.|Don|Doña|Professor|Doctor|Captain|Nurse".split("|")
#: What may come right before a value; a value may also stand alone or among any words.
_CUES = {
    "email": "email|e-mail|Email:|E-mail:|e-mail is|mail|Mail:|mailto:|my inbox is|inbox|write to|drop a note to|send it to|please copy|reply-to|From:|To:|login|account of|user|username|registered as|subscribed with|notify|address book entry|reachable via|or by mail:|the mailbox|contact at|schreiben an|E-Mail:|Mailadresse|per Mail an|Postfach|Kontakt:|weiterleiten an|angemeldet als|courriel|courriel :|mail :|écrire à|envoyez à|contact :|adresse mail|joindre sur|correo|correo:|escribir a|mandar a|contacto:|mi e-mail es|enviar a|cuenta",
    "phone": "phone|Phone:|phone number|tel|TEL|telephone|cell|cell:|cellphone|landline|fax|Fax:|whatsapp|sms to|call|please call|call back on|dial|hotline|number to reach me:|my direct line|extension line|ring me at|voicemail|Telefon|Telefon:|Handy|Handynummer|Mobil|Rufnummer|Durchwahl|anrufen unter|erreichbar unter|Festnetz|téléphone|téléphone :|portable|portable :|mon fixe|appeler le|joignable au|numéro|teléfono|teléfono:|móvil|móvil:|llamar al|número de contacto|fijo",
    "id_number": "ID|id|personal number|my papers|papers|documents|identification|identity document|for identification|card number|personal ID card|Ausweis|papiers|SSN|ssn is|SSN:|social security|social security no.|social security number|tax number|tax ID|TIN|taxpayer id|national ID|ID number|ID no.|identity card|identity number|passport|passport number|Passport:|passport no|travel document|driver's license|driving licence|driving licence no.|licence number|license #|national insurance number|NI number|NINO|residence card|health card|personal code|citizen number|Sozialversicherungsnummer|Steuernummer|Steueridentifikationsnummer|IdNr.|Personalausweis|Personalausweisnummer|Ausweis Nr.|Reisepassnummer|Pass Nr.|Führerscheinnummer|numéro de sécurité sociale|sécurité sociale|NIR|carte d'identité|carte d'identité n°|passeport|numéro de passeport|permis de conduire|numéro fiscal|DNI|DNI:|NIE|NIF|documento de identidad|pasaporte|número de pasaporte|carné de conducir|número de la seguridad social|permiso de conducir",
    "street_address": "I'm living at|I am at|resident at|lives at|home address|home address:|postal address|mailing address:|shipping address:|ship to|billing address:|bill to|send the package to|deliver it to|drop it off at|collect it from|my house at|the apartment at|come to|located at|registered at|moving to|near|in front of|behind|office at|Adresse:|Anschrift|Anschrift:|wohnhaft|wohne in der|Lieferadresse|Lieferung an|nach|Rechnungsadresse:|adresse|adresse :|domicile|domicilié au|livraison au|habite|à livrer|dirección|dirección:|domicilio|domicilio:|entregar en|vive en|vivo en|enviar a|residente en",
    "person_name": "my name is|my name is|name is|the name is|this is|it is|it was|is|was|spoke with|speaking with|talked to|thanks to|attn|attn:|Regards,\n|Kind regards,\n|Best regards,\n|Yours sincerely,\n|me llamo|mi nombre:|je m'appelle|mein Name ist|Viele Grüße\n|Beste Grüße,\n|Cordialement,\n|Saludos,\n|Saludos cordiales\n|I'm|I am|my name's|name|Name:|full name:|called|named|known as|signed|sincerely,|best,|thanks,|cheers,|yours,|love,|BR,|by|from|with|and|for|to|tell|contact|ask|met|cc:|manager|supervisor|colleague|my boss|my neighbour|my wife|my husband|our intern|customer|client|patient|tenant|candidate|author:|owner:|assignee:|attendees:|on behalf of|care of|c/o|approved by|reported by|prepared by|according to|Dear|Hello|ich bin|ich heiße|Kollege|Kollegin|mein Chef|Kunde|Kundin|von|mit|und|Mit freundlichen Grüßen\n|Gruß\n|LG\n|i.A.|Ansprechpartner:|Liebe|Lieber|je suis|mon collègue|ma collègue|mon chef|client :|de|avec|et|par|Bien à vous,\n|Bonne journée,\n|Chère|Cher|soy|mi nombre es|mi jefe|mi compañera|cliente:|con|y|por|Atentamente,\n|Un saludo,\n|Estimada|Estimado",
}
_CUES = {k: v.split("|") for k, v in _CUES.items()}
#: What may come right after a person's name as the subject of a sentence.
_DOES = "said|says|called|wrote|told us|asked|wants|has|had|will|can|is|was|needs|left|came|agreed|confirmed|forgot|signed|sent|works|lives|complained|promised|replied|knows|reported|took|hat|ist|war|will|sagt|kommt|braucht|schrieb|meinte|wollte|a dit|a|est|veut|demande|travaille|habite|dijo|tiene|está|quiere|pidió|llamó|trabaja|from accounting|from the office|, our neighbour,|(tenant)|, aged 43,".split("|")
_AFTER = ".|.|.|,|;|!|?|)| please.| thanks.| today.| tomorrow.| soon.| or come by.| if needed.| right away.| is wrong.| works best.| again.| bitte.| danke.| s'il vous plaît.| merci.| por favor.| gracias.| and wait.| but not today.||".split("|")
_FUNCTION = {
    "en": "the a of to in is was that for it on with as be at by this from or have an they which one you were all there would their we when your can said if do will each about how up out them then she many some so these".split(),
    "de": "der die das und in zu den ist nicht von sie mit dem sich auf für als auch es an werden aus er hat dass bei wir oder noch nach wird am um einen über wenn nur war so wie".split(),
    "fr": "le la les de des et un une est que dans pour pas sur au avec par ce il elle qui ne se plus sont ou nous vous mais cette aux être fait comme tout".split(),
    "es": "el la los las de y en que un una es por con no para su se lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también hasta hay".split(),
}
#: Numbers that are nobody's, by the words before them; # is a digit, @ a capital.
_NUMBERED = "order|order no.|Order #|ticket|ticket no.|case|case id|invoice|invoice no.|bill|tracking number|tracking|parcel|shipment|batch|lot|build|version|release|serial|serial number|part no.|SKU|item|job|run|commit|request|request id|session|trace|transaction|ref|reference|PO|contract|flight|train|gate|room|rack|port|error|error code|status|page|chapter|section|line|row|record|document|doc|article|policy|rule|ISBN|EAN|barcode|meter|model|machine|container|pallet|asset|incident|change|bug|issue|PR|sprint|checksum|hash|Bestellung|Auftrag|Auftragsnummer|Rechnung|Rechnungsnummer|Sendung|Sendungsnummer|Ticketnummer|Vorgang|Charge|Seriennummer|Artikelnummer|Zeile|Seite|commande|numéro de commande|facture|colis|numéro de suivi|dossier|lot n°|série|page|pedido|número de pedido|factura|envío|número de seguimiento|expediente|lote|serie|página".split("|")
_NUMBERS = "###-###-###|##-###-###|###-###-#####|#####-##-####|####-##-####|###########|############|#############|@@ ## #### ###|####|#####|######|#######|########|#########|##########|############|##-####|###-###|####-####|###-####-###|####-##-##|###.###|##.##.####|#.#.#|##.##.##|#.##.#-rc#|@@-####|@@-#####|@@@-###|@####|@#####-##|@@####|@@ ### ###|@@ ## #### ###|####/##|##/####|####-@@|@-###-###-#|###-##-#|## ### ##|### ### ###|#### ####|@#-@#-###|####@####|##@##@##|####-######|###-######|##-###-###|########-####|############@@|@@@@######|### ## ###|20##-######|20######-##|####.####".split("|")
_PLAIN = "###.##.#.##|##.##.##.##|172.##.#.###|###.###.#.#|it took ### ms|at ##:##|by ##:##|on 20##-##-##|on ##.##.20##|##/##/20##|20##-##-##T##:##:##Z|##.#%|## %|$###.##|### EUR|€ ##,##|#,### users|## of ### rows|192.168.#.##|10.#.##.#:####|v#.##|## kg|#.# GB|### km|since 20##|in 19##|Q# 20##|## + ##|###x###|page ## of ##|level #|top ##|#th|around ## degrees|lat ##.####, lon #.####|0x####|##:##:## UTC|## Grad|##.### Stück|## ans|#### jours|## días|num_steps=###|timeout: ##|http ###|HTTP/#.# ###|#####".split("|")


def words_of(folder: str) -> tuple[list[str], list[str]]:
    """(English words, words of many languages) of two public vocabulary files, as they are: the tokens that begin a word."""

    def read(name: str) -> list[str]:
        out = []
        for line in open(f"{folder}/{name}", "rb"):
            try:
                t = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            if t[:1] == " " and t[1:].isalpha() and 1 < len(t) < 13:
                out.append(t[1:])
        return out

    latin = re.compile(r"[a-zà-öø-ÿœßčšžłńśźżąęő]+")
    en = [w for w in read("byte_bpe_50k.tiktoken") if w.isascii() and w.islower() and len(w) > 2]
    many = [w for w in read("byte_bpe_multi_50k.tiktoken") if latin.fullmatch(w) and len(w) > 1]
    return en, many


def prose(locales: str | None = LOCALES) -> list[str]:
    """Sentences of the standard library's docstrings and of message catalogues in German, French and Spanish."""
    out: set[str] = set()

    def add(text: str) -> None:
        for x in re.split(r"(?<=[.?!:])\s+|\n\s*\n", text):
            x = re.sub(r"\s+", " ", x).strip()
            if 12 < len(x) < 170 and not re.search(r"@|[Aa]uthor|[Ww]ritten|[Cc]opyright|[Cc]ontribut|%[sdlu<]|>>>|[A-Z]\. [A-Z]|__", x):
                out.add(x)

    for f in sorted(Path(os.__file__).parent.glob("*.py")) + sorted(Path(os.__file__).parent.glob("*/*.py")):
        if "site-packages" in f.parts:
            continue
        try:
            tree = ast.parse(f.read_text())
        except (SyntaxError, UnicodeDecodeError):
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef)) and (doc := ast.get_docstring(node)):
                add(doc)
    english, others = sorted(out), []
    for lang in ("de", "fr", "es"):
        out.clear()
        for f in sorted(Path(locales or "/nowhere").glob(f"{lang}/LC_MESSAGES/*.mo")):
            for text in gettext.GNUTranslations(f.open("rb"))._catalog.values():
                add(text)
        others += sorted(out)
    random.Random(1).shuffle(english)
    return english[: max(4000, 2 * len(others))] + others


class Maker:
    """Composes labelled texts as pieces (text, type or '')."""

    def __init__(self, seed: int, words: tuple[list[str], list[str]], prose: list[str] = ()):
        self.r = random.Random(seed)
        self.en, self.many = words
        self.prose = prose

    # words and names

    def digits(self, shape: str) -> str:
        r = self.r
        return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in shape)

    def invented(self) -> str:
        r = self.r
        if r.random() < 0.5:
            return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouy") for _ in range(r.choice((2, 2, 3, 4)))) + r.choice(("", "", "n", "r", "s", "x", "l", "nd", "st", "k"))
        return "".join(r.choice(_HEADS) for _ in range(r.choice((1, 1, 2)))) + r.choice(_HEADS)

    def place(self) -> str:
        r = self.r
        return ("".join(r.choice(_HEADS) for _ in range(r.choice((1, 1, 2)))) + r.choice(_PLACE_TAILS)).capitalize()

    def word(self, lang: str = "") -> str:
        r = self.r
        lang = lang or r.choice(("en", "en", "de", "fr", "es"))
        if r.random() < 0.45:
            return r.choice(_FUNCTION[lang])
        w = r.choice(self.en if lang == "en" else self.many)
        return w.capitalize() if lang == "de" and r.random() < 0.4 else w

    def sentence(self) -> str:
        """A sentence of prose, now and then with a thing that has a name, a place or a number in it."""
        r = self.r
        s = r.choice(self.prose)
        if r.random() < 0.4:
            name = r.choice((self.invented().capitalize(), self.invented().capitalize(), f"{r.choice(self.en).capitalize()} {r.choice(self.en).capitalize()}", f"{self.invented().capitalize()} {r.choice(self.en)}"))
            s = re.sub(r"\b([Tt]he|[Aa]n?|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Ll][ae]s?|[Uu]ne?|[Ee]l|[Uu]na?|[Dd]e)\b", lambda m: f"{m.group(0)} {name}" if r.random() < 0.5 else m.group(0), s)
        if r.random() < 0.2:
            w = s.split(" ")
            w.insert(r.randint(1, len(w)), r.choice(("in ", "near ", "from ", "in ", "aus ", "von ", "bei ", "à ", "de ", "en ", "desde ")) + self.place())
            s = " ".join(w)
        if r.random() < 0.25:
            w = s.split(" ")
            w.insert(r.randint(1, len(w)), self.digits(r.choice(("##", "#", "###", "####", "#.#", "20##", "##:##", "#,###"))) + r.choice(("", "", ",", "")))
            s = " ".join(w)
        return s

    def salad(self, n: int) -> str:
        r = self.r
        if n and self.prose and r.random() < 0.6:
            w = r.choice(self.prose).split(" ")
            k = r.randint(0, max(0, len(w) - n))
            return " ".join(w[k : k + n]).strip(".,;:()")
        lang = r.choice(("en", "en", "de", "fr", "es"))
        out = []
        for _ in range(n):
            u = r.random()
            w = self.invented().capitalize() if u < 0.03 else r.choice(self.en).capitalize() if u < 0.06 else r.choice(self.en).upper() if u < 0.065 else self.word(lang)
            out.append(w + ("," if r.random() < 0.05 else ""))
        return " ".join(out)

    def first(self) -> str:
        r = self.r
        u = r.random()
        if u < 0.55:
            return r.choice(_FIRST)
        if u < 0.75:
            # A name nobody has listed: the beginning of one and the end of another.
            a, b = r.choice(_FIRST), r.choice(_FIRST)
            return (a[: max(2, len(a) - 2)] + b[-2:]).capitalize()
        return ("".join(r.choice("bcdfghjklmnprstvyz") + r.choice(("a", "e", "i", "o", "u", "ia", "ei")) for _ in range(r.choice((1, 2, 2)))) + r.choice(("", "n", "l", "s", "ra", "na", "k", "m", "th"))).capitalize()

    def last(self) -> str:
        r = self.r
        u = r.random()
        if u < 0.35:
            return r.choice(_LAST)
        if u < 0.8:
            w = "".join(r.choice(_HEADS) for _ in range(r.choice((0, 1, 1)))) + r.choice(_HEADS) + r.choice(_TAILS)
            if r.random() < 0.15:
                w = w.replace("o", r.choice("øöó"), 1).replace("e", r.choice("eé"), 1).replace("c", r.choice("cčć"), 1)
            return w.capitalize()
        if u < 0.87:
            return self.invented().capitalize()
        if u < 0.95:
            return r.choice(self.en).capitalize()
        return r.choice(("de ", "van ", "von ", "da ", "El ", "Le", "Mc", "Mac", "O'", "Al-", "di ", "van der ", "Ben ")) + (r.choice(_LAST) if r.random() < 0.5 else self.invented().capitalize())

    def name(self) -> str:
        r = self.r
        a, b = self.first(), self.last()
        if r.random() < 0.1:
            b += r.choice(("-", "-", " ")) + self.last()
        if r.random() < 0.06:
            a += r.choice(("-", " ")) + self.first()
        u = r.random()
        if u < 0.58:
            return f"{a} {b}"
        if u < 0.67:
            return f"{a} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {b}"
        if u < 0.80:
            return f"{a[0]}. {b}"
        if u < 0.84:
            return f"{b}, {a}"
        if u < 0.90:
            return f"{b.upper()}, {a}" if r.random() < 0.6 else f"{a} {b.upper()}"
        if u < 0.93:
            return f"{a} {b}".upper()
        return f"{a} {b}".lower()

    # values

    def email(self) -> str:
        r = self.r
        clean = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalpha()) or "box"
        a, b, w = clean(self.first()), clean(self.last()), r.choice(self.en)
        user = r.choice((f"{a}.{b}", f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}.{b}", f"{a[0]}{b}", f"{b}{a[0]}", f"{b}.{a}", a, f"{a}{self.digits('##')}", f"{a}.{b}{self.digits('#')}", f"{w}{self.digits('###')}", f"{a}+{w}", f"{w}.{b}", r.choice(("info", "support", "office", "contact", "sales", "jobs"))))
        host = r.choice((r.choice(_HOSTS), r.choice(_HOSTS), self.invented(), w, f"{w}-{r.choice(self.en)}", f"{self.invented()}-{w}", f"mail.{w}", f"{r.choice(self.en)}{r.choice(self.en)}", f"{w}{self.digits('#')}"))
        tld = r.choice(_TLDS)
        u = r.random()
        if u < 0.68:
            out = f"{user}@{host}.{tld}"
        elif u < 0.74:
            at = r.choice(("(at)", "[at]", "{at}", "<at>", " @ ", "@ ", " @", "(AT)", "[AT]"))
            out = f"{user}{at}{host}.{tld}"
        elif u < 0.84:
            out = f"{user} {r.choice(('at', 'at', 'AT', '(at)', '[at]', '(AT)'))} {host}.{tld}"
        else:
            dot = r.choice((" dot ", " dot ", " DOT ", " (dot) ", "[dot]", " [dot] ", "(dot)"))
            out = f"{user.replace('.', r.choice(('.', '.', dot)))}{r.choice((' at ', ' at ', ' AT ', ' (at) ', ' [at] ', '[at]', '(at)'))}{host}{dot}{tld.replace('.', dot)}"
        return out.upper() if r.random() < 0.06 else out.title() if r.random() < 0.02 else out

    def phone(self) -> str:
        r = self.r
        s = r.choice(
            "+1 ### ### ####|+1-###-###-####|+1 (###) ###-####|(###) ###-####|(###)###-####|###-###-####|###.###.####|### ### ####|1-###-###-####|1##########|##########|###/###-####|###/### ####|+44 #### ######|+44 ## #### ####|+44 (0)## #### ####|0#### ######|0## #### ####|0044 ## #### ####|+49 ### #######|+49 (0)## ######|+49 (0)## ##### ###|0049 ### ######|0049-##-#####-###|0### #######|0##/#######|0## #####-##|0#### / #####|+33 # ## ## ## ##|0# ## ## ## ##|0#.##.##.##.##|0033 # ## ## ## ##|+33#########|+34 ### ### ###|+34 ### ## ## ##|### ## ## ##|0034 #########|9## ### ###|+41 ## ### ## ##|+43 # ###### ##|+39 ### #######|+31 # ########|+61 # #### ####|+91 ##### #####|+48 ### ### ###|+81-##-####-####|+55 ## #####-####|+353 ## ### ####|### ####|###-####".split("|")
        )
        out = self.digits(s)
        if r.random() < 0.12:
            out += r.choice((" ext. ", " ext ", " x", ", ext. ", " Ext. ", " Durchwahl ", " poste ", "-")) + self.digits(r.choice(("##", "###", "####")))
        return out

    def idno(self) -> str:
        return self.digits(
            self.r.choice(
                "###-##-####|###-##-####|### ## ####|#########|@@ ## ## ## @|@@######@|@@ ###### @|@########|@#######|@@#######|@#####-####|#########@|########@|########-@|##.###.###-@|@-#######-@|@#######@|## ### ### ###|###########|### ### ### ##|## ###### @ ###|##/###/#####|# ## ## ## ### ### ##|# ## ## ## ### ###|##@@#####|@@@@@######@@#@@|@###-####-####|@###-######-##|######-####|######-####@|######+####|######@###@|#### #### ####|###.###.###-##|@@@@@####@|#### #### #### ####|@#@#@#@##|@##@##@##|@@####@##|## ### ### ##|### ### ###|@@@######|@@@ ### ###|@@ ### ###|@@@@######".split("|")
            )
        )

    def address(self) -> str:
        r = self.r
        road = lambda: r.choice((r.choice(_TREES), r.choice(self.en).capitalize(), r.choice(_LAST), self.place(), self.invented().capitalize(), f"{r.choice(('Old', 'New', 'Upper', 'Great', 'Saint', 'Long'))} {r.choice(self.en).capitalize()}", f"{r.choice(self.en).capitalize()} {r.choice(_TREES)}"))
        n = str(r.choice((r.randint(1, 99), r.randint(1, 300), r.randint(100, 9999)))) + (r.choice("abcAB") if r.random() < 0.1 else "")
        t = r.choice((self.place(), self.place(), self.invented().capitalize(), f"{self.place()} {r.choice(self.en).capitalize()}"))
        sep = r.choice((", ", ", ", ", ", "\n", " "))
        zone = r.choice(("", f" {self.digits('#####')}", f"{sep}{self.digits('@@ #####')}", f" {self.digits('@@# #@@')}", f" {self.digits('@@ ## ###')}"))
        unit = r.choice((f"Apt {r.randint(1, 99)}", f"Apt. {r.randint(1, 40)}{r.choice('ABCD')}", f"Unit {r.randint(1, 60)}", f"#{r.randint(1, 60)}", f"Suite {r.randint(100, 900)}", f"Floor {r.randint(2, 30)}"))
        k = r.random()
        if k < 0.24:
            return f"{n} {road()} {r.choice(_WAYS)}" + r.choice(("", f"{sep}{t}", f"{sep}{t}{zone}", f"{sep}{t}{zone}"))
        if k < 0.34:
            return f"{n} {road()} {r.choice(_WAYS)}, {unit}{sep}{t}{zone}"
        if k < 0.46:
            return f"{r.choice(('Flat', 'Flat', 'Apartment', 'Apt', 'Unit', 'Room', 'Studio'))} {r.randint(1, 60)}{r.choice(('', '', 'A', 'b'))}, {n} {road()} {r.choice(_WAYS)}{sep}{t}{zone}"
        post = self.digits(r.choice(("#####", "#####", "####", "D-#####")))
        if k < 0.66:
            name = r.choice((r.choice(_TREES).lower(), r.choice(_LAST).lower(), r.choice(self.many), r.choice(self.en), self.invented()))
            way = r.choice(_DE_WAYS)
            s = r.choice((f"{name.capitalize()}{way}", f"{name.capitalize()}{way}", f"{name.capitalize()}-{way.capitalize()}", f"{name.capitalize()}er {way.capitalize()}", f"Am {name.capitalize()}", f"An der {name.capitalize()}"))
            return f"{s} {n}" + r.choice(("", f"{sep}{post} {t}", f"{sep}{post} {t}", f", {t}"))
        what = r.choice((r.choice(self.many), r.choice(_LAST), self.invented().capitalize(), self.place(), r.choice(self.many).capitalize()))
        if k < 0.83:
            s = r.choice(_FR_WAYS)
            s = s.capitalize() if r.random() < 0.2 else s
            return f"{n}{r.choice((', ', ' ', ' bis ', ', '))}{s} {what}" + r.choice(("", f"{sep}{post} {t}", f", {t}", f"{sep}{post} {t}"))
        return f"{r.choice(_ES_WAYS)} {what}{r.choice((' ', ', ', ', n.º ', ' nº '))}{n}" + r.choice(("", f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", {r.choice(('piso', 'bajo', 'puerta'))} {r.randint(1, 9)}")) + r.choice(("", f"{sep}{post} {t}", f", {t}", f"{sep}{post} {t}"))

    def value(self, kind: str) -> str:
        return {"email": self.email, "phone": self.phone, "id_number": self.idno, "street_address": self.address, "person_name": self.name}[kind]()

    # sentences

    def titled(self) -> str:
        """A title, team, product or place: capitalised, and no person."""
        r = self.r
        w = lambda: r.choice(self.en).capitalize()
        x = self.invented().capitalize()
        return r.choice((f"{w()} {w()}", f"the {w()} {w()}", f"{w()} {w()} {w()}", f"the {w()} {w()}", f"the {x} {r.choice(self.en)}", f"{x} {w()}", f"the {x} {w()}", f"{r.choice(self.en)} {x}", f"{x}", self.place(), f"{w()} {self.place()}", f"team {w()} {w()}", f"{w()} of {w()}", f"{x} {self.digits('#')}", f"{x}-{r.choice(self.en)}", f"@{r.choice(self.en)}-{r.choice(self.en)}", f"{w()}{w()}", f"{r.choice(self.many).capitalize()} {r.choice(self.many).capitalize()}", f"{x} {r.choice(self.many)}", f"el {r.choice(self.many)} {x}", f"die {r.choice(self.many).capitalize()} {x}", f"le {r.choice(self.many)} {x}"))

    def nobody(self) -> str:
        r = self.r
        u = r.random()
        if u < 0.08:
            n = lambda: self.digits(r.choice(("#", "##", "###")))
            w = lambda: r.choice((self.word(), r.choice(_NUMBERED), r.choice(self.en)))
            return r.choice((f"{w()} {n()}, {w()} {n()}, {w()} {n()} {self.salad(3)}", f"{self.salad(1)} {w()} {n()}, {self.titled()}", f"{w()} {n()} {w()} {n()} {self.salad(2)}", f"{n()} {w()} {self.salad(2)}, {n()} {w()}", f"{w()} {n()} {self.salad(4)}", f"{n()}. {self.salad(4)}")).capitalize() + r.choice((".", ".", "", "?"))
        if u < 0.36:
            s = f"{r.choice(_NUMBERED)}{r.choice((' ', ' ', ': ', ' #', '=', ' is ', ' no. ', '-'))}{self.digits(r.choice(_NUMBERS))}"
            s = s[0].upper() + s[1:] if r.random() < 0.5 else s
            return r.choice((s, f"{s} {r.choice(('was', 'is', 'has', 'ist', 'wurde', 'est', 'es', 'and', 'will', 'did', 'matched', 'failed'))} {self.salad(r.randint(1, 5))}", f"{s} {self.salad(r.randint(1, 5))}", f"{self.salad(r.randint(1, 5))} {s}", f"{self.digits(r.choice(_NUMBERS))} {self.salad(2)}")) + r.choice((".", "", ",", "?"))
        if u < 0.56:
            return f"{self.salad(r.randint(0, 5))} {self.digits(r.choice(_PLAIN))}{r.choice(('', ' ' + self.salad(3)))}".strip() + r.choice((".", "", "?", ";"))
        if u < 0.86:
            t = self.titled()
            cue = r.choice(_CUES["person_name"]).rstrip("\n") if r.random() < 0.1 else r.choice((self.word(), "the", "in the", "see", "of", "open", "das", "die", "le", "la", "el", "in", "at", r.choice(_CUES["street_address"])))
            s = r.choice((f"{t} {r.choice(_DOES)} {self.salad(r.randint(1, 5))}", f"{self.salad(r.randint(1, 4))} {t} {self.salad(r.randint(0, 4))}", f"{cue} {t}", f"{cue} {t} {self.salad(2)}", t, f"{t} {r.choice(('and', 'or', 'und', 'et', 'y', '/', ','))} {self.titled()}"))
            return s.strip() + r.choice((".", ".", "?", "", ":", "!"))
        if u < 0.93:
            # A capital at the beginning of a sentence, and a thing or place after it.
            lang = r.choice(("en", "de", "fr", "es"))
            lead = r.choice(({"en": ("in", "at", "near", "from", "the", "our", "for", "with", "when", "since"), "de": ("in", "bei", "aus", "das", "der", "die", "im", "am", "seit", "von"), "fr": ("à", "le", "la", "les", "depuis", "de", "chez", "un"), "es": ("en", "el", "la", "los", "desde", "de", "un", "cerca de")}[lang])).capitalize()
            noun = r.choice(self.en) if lang == "en" else r.choice(self.many).capitalize() if lang == "de" else r.choice(self.many)
            x, at = r.choice((self.invented().capitalize(), self.place())), {"en": "near", "de": "bei", "fr": "près de", "es": "cerca de"}[lang]
            return r.choice((f"{lead} {x}", f"{lead} {x}, {self.salad(2)}", f"{lead} {noun} {x}", f"{lead} {noun} {x} {at} {self.place()}", f"{lead} {x} {noun} {at} {self.place()}", f"{lead} {noun} {at} {self.place()}")) + f" {self.salad(r.randint(1, 6))}{r.choice(('.', '.', '?', ''))}"
        w = self.invented()
        return r.choice((f"https://{w}.{r.choice(_TLDS)}/{r.choice(self.en)}", f"see www.{w}.{r.choice(_TLDS)}", f"/{r.choice(self.en)}/{r.choice(self.en)}.{r.choice(('log', 'txt', 'py', 'json'))}", f"{r.choice(self.en).upper()}:", f"{r.choice(self.en).capitalize()}:", f"## {self.titled()}", f"- {self.salad(3)}", f"[{r.choice(self.en)}-{self.digits('###')}] {self.salad(4)}", f"{r.choice(self.en)}@{self.digits('#.#')}", f"@{r.choice(self.en)}{r.choice(('', '-' + w))} {self.salad(2)}", f"{self.digits('########')}-{self.digits('####')}-{self.digits('####')}", f"{r.choice(self.en)}_{r.choice(self.en)}={self.digits('##')}", f"{r.choice(self.en)} at {r.choice(self.en)} {self.salad(2)}", f"{r.choice(self.en)} dot {r.choice(self.en)}", f"{r.choice(self.en).upper()} {r.choice(self.en).upper()}", self.digits("####"), f"<{r.choice(self.en)}>{self.salad(2)}</{r.choice(self.en)}>"))

    def mention(self, kind: str) -> list[tuple[str, str]]:
        r = self.r
        v = (self.value(kind), kind)
        before = f"{self.salad(r.randint(1, 5))} " if r.random() < 0.4 else ""
        after = r.choice(_AFTER) if r.random() < 0.6 else f" {self.salad(r.randint(1, 5))}{r.choice(('.', '.', '', '?'))}"
        u = r.random()
        if kind == "person_name":
            if before and r.random() < 0.4:
                after = f" {self.salad(r.randint(2, 7))}."
                return [(before[0].upper() + before[1:], ""), v, (after, "")]
            if u < 0.22:
                lead = r.choice(("", "", before, before.capitalize()))
                return [(lead, ""), v, (f"{'' if (d := r.choice(_DOES))[0] == ',' else ' '}{d} {self.salad(r.randint(1, 5))}.", "")]
            if u < 0.36:
                return [(f"{before}{r.choice(_TITLES)} ", ""), v, (after, "")]
            if u < 0.42:
                return [(f"{before}(", ""), v, (")" + after, "")]
            if u < 0.54:
                other = r.choice(("phone", "phone", "email", "id_number", "street_address"))
                lead, tail = r.choice(((" (", ")"), (" (", ")"), (", ", ""), (" <", ">"), (" - ", ""), (" | ", " |"), (", tel. ", ""), (": ", "")))
                out = [(before, ""), v, (lead, ""), (self.value(other), other), (tail, "")]
                return out + ([(r.choice((" and ", ", ", " und ", " et ", " y ")), ""), (self.name(), kind), (after, "")] if r.random() < 0.3 else [(after, "")])
            if u < 0.58:
                return [(before, ""), v, (r.choice((" and ", ", ", " / ", " und ", " et ", " y ", "; ")), ""), (self.name(), kind), (after, "")]
        elif kind == "id_number":
            # Only what stands before or behind it tells whose number it is.
            cue = r.choice(_CUES[kind])
            if r.random() < 0.4:
                cue = f"{r.choice(('identity', 'id', 'national', 'tax', 'taxpayer', 'social security', 'national insurance', 'insurance', 'passport', 'licence', 'license', 'driver licence', 'drivers license', 'driving licence', 'card', 'identity card', 'personal', 'document', 'residence permit', 'citizen'))}{r.choice(('', ' no', ' no.', ' number', ' id', ' code', ' #', ' nr', ' card', ' on file', ' num.'))}"
            if u < 0.08:
                return [(before, ""), v, (f" {r.choice(('was issued in', 'expires in', 'has expired', 'was shown at the', 'was checked at the', 'was copied at the', 'was noted at the', 'was asked for at the', 'gilt bis', 'expire en', 'caduca en', 'was taken down by the'))} {self.salad(r.randint(1, 4))}.", "")]
            if u < 0.2:
                return [(before, ""), v, (f" {r.choice(('is', 'as', 'on', '=', '(', 'ist', 'est', 'es', 'stands on', 'was printed on', 'belongs to'))} {r.choice(('my', 'the', 'his', 'her', 'meine', 'mon', 'mi', ''))} {cue}{after}", "")]
            cue = f"{r.choice(('my', 'his', 'her', 'the', 'our', 'mein', 'meine', 'mon', 'ma', 'mi', 'a'))} {cue}" if r.random() < 0.35 else cue
            cue = cue[0].upper() + cue[1:] if r.random() < 0.4 else cue
            return [(f"{before}{cue}{r.choice((' ', ' ', ': ', ' is ', ' no. ', ' # ', ' number ', ' (', ' n° ', ' Nr. ', ' lautet ', ' est ', ' es ', '=', ' = '))}", ""), v, (after, "")]
        if u < 0.12 and kind != "id_number":
            return [v]
        if u < 0.24 and kind != "id_number":
            return [(f"{before}{r.choice(('(', '<', '[', '- ', '* ', '| '))}", ""), v, (r.choice((")", ">", "]", " |", "")) + after, "")]
        if u < 0.36 and kind != "id_number":
            return [(f"{self.salad(r.randint(1, 5))} ", ""), v, (f" {self.salad(r.randint(1, 5))}.", "")]
        cue = r.choice(_CUES[kind])
        cue = cue[0].upper() + cue[1:] if r.random() < 0.4 else cue
        gap = "" if cue.endswith(("\n", "mailto:")) else r.choice((" ", " ", " ", ": ", " is ", " - ", "=", "\n") if kind != "person_name" else (" ", " ", " ", ": ", "\n"))
        return [(f"{before}{cue}{gap}", ""), v, (after, "")]

    def text(self) -> list[tuple[str, str]]:
        r = self.r
        units = [r.choice(TYPES) for _ in range(r.choice((0, 1, 1, 2, 2, 3)))] + ["person_name"] * r.choice((0, 0, 1))
        units += ["none"] * r.choice((0, 1, 2, 3, 4)) + ["salad"] * r.choice((0, 1, 1, 2, 3))
        r.shuffle(units)
        if r.random() < 0.5:
            units = units[: r.choice((1, 1, 2, 3))]
        out: list[tuple[str, str]] = []
        if r.random() < 0.06:
            sep = r.choice((", ", " | ", "; ", "\t", " - ", "\n", " "))
            kinds = [r.choice(TYPES[:2] + TYPES[3:]) for _ in range(r.randint(2, 4))]
            for k, kind in enumerate(kinds):
                out += ([(sep, "")] if k else []) + ([(f"{r.choice(_CUES[kind])}{r.choice((': ', '=', ' '))}", "")] if r.random() < 0.3 else []) + [(self.value(kind), kind)]
        for u in units:
            if out:
                out.append((r.choice((" ", " ", " ", "\n", "\n\n", "  ")), ""))
            if u == "none":
                out.append((self.nobody(), ""))
            elif u == "salad" and self.prose and r.random() < 0.75:
                out.append((self.sentence(), ""))
            elif u == "salad":
                s = self.salad(r.randint(2, 10))
                out.append((s[:1].upper() + s[1:] + r.choice((".", ".", "?", "!", ":", "")), ""))
            else:
                m = self.mention(u)
                if r.random() < 0.5 and m and not m[0][1] and m[0][0]:
                    m[0] = (m[0][0][0].upper() + m[0][0][1:], "")
                out += m
        return out


def labelled(m) -> tuple[np.ndarray, np.ndarray, str]:
    """(symbols, labels, text) of one text of a maker: anything with text() and r."""
    text, y = "", []
    for piece, typ in m.text():
        text += piece
        if typ:
            b = 1 + 2 * TYPES.index(typ)
            y += [b] + [b + 1] * (len(piece) - 1)
        else:
            y += [0] * len(piece)
    return encode(text).astype(np.int64), np.array(y, np.int64), text


def batch(m: Maker, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.zeros((width, size), np.int64)
    gold = np.zeros((width, size), np.int64)
    mask = np.zeros((width, size), np.float32)
    k = 0
    while k < size:
        a, y, _ = labelled(m)
        if not len(a):
            continue
        # A text is cut at either end or at both.
        lo = m.r.choice((0, len(a) - width, m.r.randint(0, len(a) - width))) if len(a) > width else 0
        n = min(width, len(a) - lo)
        ids[:n, k], gold[:n, k], mask[:n, k] = a[lo : lo + n], y[lo : lo + n], 1
        k += 1
    return ids, gold, mask


def measure(found, m, n: int) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each type over n texts of a maker; found: text to mentions (type, start, end)."""
    both, got, want = np.zeros(len(TYPES)), np.zeros(len(TYPES)), np.zeros(len(TYPES))
    for _ in range(n):
        _, y, text = labelled(m)
        a = {(k, b) for k, b, _ in found(text)}
        b = {(k, b) for k, b, _ in spans_of(y)}
        for s, arr in ((a, got), (b, want), (a & b, both)):
            for k, _ in s:
                arr[k] += 1
    return {t: (round(both[k] / max(1, got[k]), 3), round(both[k] / max(1, want[k]), 3)) for k, t in enumerate(TYPES)}


def _worker(pipe, seed: int, words: tuple[list[str], list[str]], texts: list[str], size: int, width: int) -> None:
    m = Maker(seed, words, texts)
    while (p := pipe.recv()) is not None:
        ids, gold, mask = batch(m, size, width)
        pipe.send(loss_and_grads(p, ids, gold, mask))


def train(minutes: float, workers: int = 8, hidden: int = 24, size: int = 20, width: int = 140, folder: str = TOKENIZERS, locales: str | None = LOCALES, start: dict[str, np.ndarray] | None = None, log=print) -> dict[str, np.ndarray]:
    words, texts = words_of(folder), prose(locales)
    p = start or init_params(hidden)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    ctx = multiprocessing.get_context("fork")
    pipes = []
    for k in range(workers):
        here, there = ctx.Pipe()
        ctx.Process(target=_worker, args=(there, (2000 if start else 1000) + k, words, texts, size, width), daemon=True).start()
        pipes.append(here)
    began, step, seen = time.time(), 0, 0.0
    while (used := (time.time() - began) / 60) < minutes:
        for pipe in pipes:
            pipe.send(p)
        got = [pipe.recv() for pipe in pipes]
        n = size * workers
        g = {k: sum(x[1][k] for x in got) / n for k in p}
        loss = sum(x[0] for x in got) / n
        step += 1
        clip = min(1.0, 5.0 / (np.sqrt(sum(float((v * v).sum()) for v in g.values())) + 1e-9))
        rate = (0.006 if start else 0.012) * min(1.0, step / 30) * max(0.02, 1 - used / minutes)
        for k in p:
            d = g[k] * clip
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.99 * m2[k] + 0.01 * d * d
            p[k] = p[k] - (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        seen = 0.95 * seen + 0.05 * loss if step > 1 else loss
        if step % 500 == 0:
            log(f"step {step} {used:.1f} min loss {seen:.3f}", flush=True)
    for pipe in pipes:
        pipe.send(None)
    t = Tagger(p)
    log("other texts of the same maker (precision, recall)", measure(lambda s: spans_of(t.viterbi(t.emissions(encode(s).astype(np.int64)[:, None]))[:, 0]) if s else [], Maker(99, words, texts), 400), flush=True)
    return p


if __name__ == "__main__":
    begin = None
    if len(sys.argv) > 6:
        with np.load(sys.argv[6]) as z:
            begin = {k: z[k].astype(np.float32) for k in z.files if k != "labels"}
    params = train(float(sys.argv[2]) if len(sys.argv) > 2 else 8.0, int(sys.argv[3]) if len(sys.argv) > 3 else 8, folder=sys.argv[4] if len(sys.argv) > 4 else TOKENIZERS, locales=sys.argv[5] if len(sys.argv) > 5 else LOCALES, start=begin)
    np.savez_compressed(sys.argv[1], **{k: v.astype(np.float16) for k, v in params.items()}, labels=np.array(LABELS))
