"""A second composer of labelled texts: shares no template, name, host or street with the one the tagger was trained on."""

import random

NAMES = "Walter Brennan|Dolores Haze|Edmund Blackadder|Rosa Luxemburg|Konrad Adenauer|Ludwig Erhard|Simone Veil|Marcel Proust|Jules Verne|Federico Lorca|Miguel Cervantes|Isabel Allende|Virginia Woolf|Arthur Doyle|Charlotte Brontë|Bertha Suttner|Otto Hahn|Lise Meitner|Gustave Eiffel|Colette Renard|Octavio Paz|Ramona Quiroga|Harold Pinter|Doris Lessing|Nikolaus Otto|Clara Zetkin|Denis Diderot|Rosalía Castro|Winston Ashby|Gertrude Stein|P. Vandermeer|K. Thistlewood|J. Abendroth|Delphine Roussel|Ulrich Pfefferkorn|Consuelo Arteaga".split("|")
HOSTS = "northwind.com|contoso.org|initech.net|hooli.io|umbrella.co.uk|stadtwerke.de|poste.fr|correo.es|globex.eu|acme.info".split("|")
USERS = "walter.b|dolores_h|e.blackadder|rosa1919|k-adenauer|simone.veil|jverne|lorca.f|ialle|v.woolf82|helpdesk|otto+news".split("|")
ROADS = "27 Baskerville Mews|1640 Riverside Drive, Hill Valley|Flat 3, 12 Grimmauld Place, London|742 Evergreen Terrace, Springfield|Unit 9, 55 Harbourside Road, Bristol|Kantstraße 152, 10623 Berlin|Löwengasse 41, 1030 Wien|14, rue Mouffetard, 75005 Paris|8 avenue Foch, 67000 Strasbourg|Calle Serrano 61, 28006 Madrid|Avenida Libertad 19, 30009 Murcia|Sonnenallee 7a, 12047 Berlin".split("|")
PHONES = "+1 206 555 7788|(312) 555-9911|0161 496 0733|+44 113 496 0999|030 901820|+49 89 636 48018|01 53 19 98 40|+33 1 70 39 62 00|915 22 91 00|+34 933 17 23 09|503-555-2231|0049 221 4710 811".split("|")
IDS = "578-31-9046|QQ 12 34 56 B|C01X00T47|L6Z9PK0R8|36 574 261 809|2 69 05 49 588 157 80|53412867-K|X4098127Q|HANSS 612053 J9|AB4471902|870 14 3391|19850412-2384".split("|")
FRAMES = {
    "email": "You will find me under {} during the week.|My old box is full; {} is the new one.|Der Newsletter ging an {} und kam zurück.|Pouvez-vous renvoyer le fichier vers {} ?|El informe llegó a {} sin adjunto.|Both {} and the shared box received it.",
    "phone": "After office hours people use {} instead.|Her phone {} is switched off.|Am besten klappt es telefonisch: {}.|Vous pouvez rappeler au {} avant midi.|Si hay dudas, el teléfono es {}.|The line {} was busy all morning.",
    "id_number": "The form wants my passport number, which is {}.|Her social security number {} was typed twice.|Auf dem Ausweis steht die Nummer {}.|Le numéro de passeport {} est périmé.|El DNI {} no aparece en la lista.|I typed driving licence {} into the wrong box.",
    "street_address": "The sofa should be brought to {}, second floor.|Since May the family lives at {}.|Das Paket wurde bei der Adresse {} abgegeben.|Le plombier passera au {} demain.|El cartero dejó la carta en {}.|Nobody opened the door at {} this morning.",
    "person_name": "The chair was taken by {} before noon.|Our new teacher, {}, starts on Monday.|Am Freitag hat {} das Büro verlassen.|C'est {} qui a fermé la porte.|Ayer {} perdió las llaves.|Tell {} that the meeting moved.|Sincerely yours,\n{}",
    "": "The harvest of 1998 was sold for 12,400 pounds.|Receipt 5519-220 covers two nights.|Blue Horizon Travel opened a desk in Lisbon.|Room 214 is next to the lift.|Der Zug 4711 fährt von Gleis 9 ab.|La factura 2024/118 está pagada.|Le vol 332 part à 18:45.|Chapter 12 of the handbook explains the second step.|The Golden Lantern serves soup until ten.|Firmware 7.2.19 fixes the clock.|La reunión empieza a las 9:30.|Das Museum hat montags geschlossen.",
}
VALUES = {"email": [f"{u}@{h}" for u in USERS for h in HOSTS], "phone": PHONES, "id_number": IDS, "street_address": ROADS, "person_name": NAMES}


class Foreign:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def text(self):
        r, out = self.r, []
        for _ in range(r.randint(1, 5)):
            kind = r.choice(["email", "phone", "id_number", "street_address", "person_name", "", "", ""])
            frame = r.choice(FRAMES[kind].split("|"))
            if out:
                out.append((r.choice((" ", "\n")), ""))
            if kind:
                a, b = frame.split("{}")
                out += [(a, ""), (r.choice(VALUES[kind]), kind), (b, "")]
            else:
                out.append((frame, ""))
        return [p for p in out if p[0]]
