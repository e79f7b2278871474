"""The labelled texts on which the personal data model is trained: templates written for it, filled by rule.

``{P}`` person, ``{E}`` email, ``{T}`` phone, ``{I}`` identity number, ``{A}`` address are mentions; small letters stand
for harmless things that look similar. No template follows a text of the test tables. At most ``MAX_ROWS`` texts are used.
"""

from __future__ import annotations

import random

MAX_ROWS = 3000

KINDS = {"P": "person", "E": "email", "T": "phone", "I": "id_number", "A": "address"}

GIVEN = (
    "Agnes Boris Clement Dalia Erik Fiona Gustav Helena Igor Julia Karl Livia Marco Nora Oskar Paula Quentin Rita Stefan Thea Ulrich Vera Willem Xenia Yusuf Zora "
    "Aline Bastian Carmen David Elena Florian Gisela Henri Irene Jakob Katrin Laurent Maria Nikolai Olga Pablo Rafael Sofia Thomas Ursula Valentin Wanda Adele Bernard Cecilia Diego Esther Fabian Gloria Hector Isabel Jonas Kamil Lotte Martin Nina Otto Pilar Robert Silvia Teodor Amir Leila Kenji Yuki Chen Priya Arjun Fatou Moussa Aya".split()
)
STEMS = "Alm Bran Carl Dorn Erl Falk Gris Holm Jans Kolb Lind Mont Norr Oster Pall Rost Sand Torr Varg Wend".split()
TOWNS = "Ambleworth Bramfield Coldwater Drayhurst Elmcaster Foxhollow Greenhythe Hartbury Ivydale Kelmscot".split()
NOUNS = (
    "violin tractor blanket pantry schedule turbine lecture pavement bicycle curtain parcel fountain notebook trumpet greenhouse telescope "
    "battery cabinet elephant forest hammock insect jacket lantern mirror needle octopus pillow quarry ribbon saddle ticket umbrella vaccine wallet zipper budget climate engine glacier".split()
)
ADJECTIVES = "Green Small Famous Silent Northern Modern Golden Early Royal Hollow Annual Better Clever Digital Empty Fresh Gentle Heavy Internal Joint Late Mobile Narrow Organic Public Quick Regional Secret Total Upper Virtual Wooden Private Special Vital".split()
#: Common words whose endings are those of many family names.
LOOKALIKES = "Highland Garland Demand Brand Standard Keyboard Backyard Postcard Button Cotton Carton Skeleton Fireman Chairman Workman Artist Tourist Specialist Copyright Midnight Spotlight Cookbook Textbook Outlook Ruins Margins Cartridge Porridge Knowledge Mustard Wizard Password Sword Record Protein Vein Hero Sombrero Casanova Bikini".split()
VERBS = "joined chaired left founded studied directed quoted thanked rejected signed drew carved".split()

#: Texts with mentions, in the languages of the data.
TEMPLATES = [
    "{P} {verb} the committee last winter.", "The minutes were taken by {P}.", "Our guest tonight is {P}, who {verb} the orchestra.", "As {P} once put it, every {noun} needs patience.", "Nothing was heard of {P} after that.",
    "{P} and {P} {verb} the same school.", "A portrait of {P} hangs in the corridor.", "Editor: {P}", "Author: {P}\nReviewed by {P}", "Signed,\n{P}", "Kind regards,\n{P}\n{T}", "Best wishes\n{P}\n{E}", "Dear {P},\nthank you for the {noun}.",
    "\"It broke twice,\" {P} explained.", "\"Come early,\" said {P}.", "Then {P} laughed. So did {P}, and the {noun} was forgotten.", "Interview: {P}\n\nThe {noun} came first.", "{P} was born in {town}.", "{P}, born in {town}, {verb} the guild at nineteen.",
    "\n{P}\n", "{P}\n", "Cast: {P}, {P}, {P}", "Present: {P}; {P}; {P}.", "Mrs. {P} {verb} it.", "Mr {P} bought a {noun}.", "Dr. {P} cured it.", "Ms. {P} runs the office, Prof. {P} the clinic.", "Captain {P} kept a log.",
    "We spoke with {P} about the {noun}.", "the {noun} that {P} repaired", "the {noun} repaired by {P}, according to {P}", "{P} (left) and {P} (right)", "Photograph: {P}", "Text: {P}", "Words by {P}.", "{P} writes about music.",
    "Until 1950 {P} {verb} the firm.", "In spring {P} {verb} a {noun}.", "When {P} arrived, the {noun} was gone.", "Yesterday {P} {verb} the {noun} in {town}.", "For {P} it was only a {noun}.", "A letter to {P} came back.", "{P} DIED IN {TOWN}.",
    "first {P} and later {P} paid", "Both {P} and {P} left early.", "They brought {P} and a friend along.", "the painters {P} and {P}", "They were {P} and {P}.", "{P} and family", "thanks {P} and all others", "a duet of {P} and Mr. {P}", "{P} or {P} will help.",
    "Frau {P} leitet das Amt.", "Herr {P} und seine Tochter wohnen hier.", "Das Buch schrieb {P}.", "Im Garten sprach {P} mit allen.", "Gezeichnet: {P}", "Der Brief ist von {P}, nicht von {P}.", "Autor: {P}",
    "Madame {P} habite au village.", "Monsieur {P} vend du pain.", "Le tableau est de {P}.", "Selon {P}, rien ne presse.", "Signé : {P}", "Avec {P} et {P} dans la salle.", "Auteur : {P}",
    "La señora {P} canta bien.", "Don {P} vive solo.", "El libro es de {P}.", "Según {P}, no hay prisa.", "Firmado: {P}", "Lo dijo {P} en la plaza.", "Autora: {P}",
    "Please ring {T} after six.", "Our switchboard is {T}.", "You can phone us on {T}, day or night.", "Dial {T} and ask for the porter.", "Mobile: {T}", "Fax: {T}", "Cell {T}", "Hotline {T}", "Office phone {T}, fax {T}", "Bookings: {T}", "Call {T} now!",
    "Text {T} to reserve the {noun}.", "If you find a {noun}, {T} is the number to try.", "the desk ({T}) is open", "({T})", "{T}", "\n{T}\n", "Write to us or call: {T}.", "Emergency number: {T}",
    "Rufen Sie uns an: {T}.", "Tel.: {T}", "Tel. {T}", "Fon {T}", "Handy: {T}", "Unsere Rufnummer lautet {T}.", "Mobil {T}", "Appelez le {T}.", "Tél. : {T}", "Portable : {T}", "On nous joint au {T}.", "Llame al {T}.", "Tfno. {T}", "Móvil: {T}", "Nuestro número es el {T}.",
    "Send questions to {E}.", "E-mail: {E}", "Email {E} for a copy.", "Write to {E}", "{E}", "<{E}>", "({E})", "{P} ({E})", "{P} <{E}>", "{P}, {E}", "{P}: {E}, {T}", "Replies go to {E}, please.", "My address is {E}, or ask {P}.", "Forward it: {E}; {E}",
    "Schreiben Sie an {E}.", "E-Mail: {E}", "Écrivez à {E}.", "Courriel : {E}", "Escriba a {E}.", "Correo: {E}",
    "He showed a passport, {I}, at the desk.", "Passport number {I}", "passport {I} expired", "Her social security number is {I}.", "SSN {I}", "SSN: {I}", "social security {I} on file", "National insurance number: {I}", "NI no. {I}", "national insurance {I}",
    "identity card {I}", "ID card number {I}", "ID: {I}", "national ID {I}", "The form asks for a name ({P}) and an identity number ({I}).", "{P}, passport {I}, flew home.", "{P}, born 1970, ID {I}", "his papers, {I}, were lost", "registered under {I} in {town}",
    "Personalausweis {I}", "Ausweisnummer: {I}", "Reisepass Nr. {I}", "Passeport n° {I}", "carte d'identité {I}", "numéro d'identité {I}", "Pasaporte {I}", "DNI {I}", "documento de identidad {I}",
    "We meet at {A}.", "The shop moved to {A}.", "Our office is at {A}, {town}.", "Visit us: {A}, {town} {n5}", "{A}", "{A}\n{town}", "\n{A}\n{n5} {town}\n", "Parcels for {P}, {A}, {town}", "{P}\n{A}\n{town} {n5}\n{T}", "He lives in a flat at {A}.", "Flowers were left outside {A}.",
    "Address: {A}", "Postal address: {A}, {town}", "a fire at {A} last night", "Between 1990 and 1995 she rented {A}.", "Studio: {A}. Phone: {T}.", "Come to {A} on Monday.", "{P} of {A}", "Owner: {P}, {A}",
    "Unser Laden ist in der {A}.", "Er wohnt {A}, {n5} {town}.", "Anschrift:\n{A}\n{n5} {town}", "Nous habitons {A}.", "Rendez-vous au {A} à midi.", "Siège : {A}, {n5} {town}", "Vivimos en {A}.", "La tienda está en {A}, {town}.", "Domicilio: {A}, {n5} {town}",
    "name: {P}\nphone: {T}\nmail: {E}", "{P} | {T} | {E}", "{P};{E};{T}", "Name: {P}, Address: {A}, Phone: {T}", "Applicant {P}, {A}, {I}", "Person to contact: {P}, phone {T}, email {E}",
]
#: Texts without mentions.
HARMLESS = [
    "Your order {code} has shipped.", "Order no. {code}", "order number {code} is late", "Part number {code}", "part {code} fits", "Spare part: {code}", "Invoice {code} is due.", "invoice no. {code}", "Ref. {code}", "Our reference: {code}", "Serial number {code}", "serial {code}",
    "Model {code}", "Item {code}", "batch {code}", "Tracking number {L2}{n9}{L2}", "tracking {L2}{n9}", "Track it with {code}", "ISBN {isbn}", "ISBN: {isbn}", "the book {isbn} is out of print", "Catalogue no. {code}", "Ticket {code}", "Case {code}", "Account {code}", "Lot {n3}-{n4}",
    "Version {n1}.{n2}.{n1}", "release {n1}.{n2}.{n3}", "v{n1}.{n1}.{n4}", "build {n4}.{n2}", "grid ref. {n3} {n3}", "map square {n4} {n4}", "grid {L2} {n3} {n3}", "coordinates {n2}.{n4}, {n1}.{n4}",
    "Rechnung Nr. {code}", "Bestellnummer {code}", "Artikelnummer {code}", "Facture n° {code}", "Commande {code}", "Pedido {code}", "Factura {code}", "Referencia {code}",
    "From {year}-{year} he was away.", "({year}-{year})", "© {year}-{year} {Noun} Inc.", "{year}-{year} {F} Partners", "between {year} and {year}", "open {time}-{time}", "{time} {time} {time}", "trains at {time}, {time} and {time}", "{date}", "On {date} it rained.", "{date} {time}",
    "{n4}-{n2}-{n2} {time}:{n2} ERROR worker={n4} {noun}.{noun}", "population {n2},{n3}", "{n2},{n3},{n3} people", "{n1}.{n2} {n2}.{n2} {n3}.{n2}", "{n3} {n3} {n3} {n3}", "{n4} {n4}", "{n5}", "{n9}", "{n3}. {Noun}", "${n3}.{n2} and ${n2}.{n2}", "{n2} x {n3} mm", "{n2}-{n2} degrees",
    "{noun} | {n4} | {n2}.{n2} | {n5}", "{noun};{n5};{n3}", "{noun},{n4},{n6},{town}", "{noun}\t{n5}\t{n4}", "id={n6} size={n5}", "Room {n3}, floor {n1}", "Chapter {n2} page {n3}", "{n2} {adj} {noun}s", "{n1} {Noun} {n1}",
    "Follow @{noun}_{noun} there.", "Thanks, @{noun}{n2}!", "{noun} @ {n2}", "@{noun} and @{noun} agree.", "mail us @ {town}",
    "The {F} Bridge is closed.", "crossing {F} Bridge at night", "{F} Street is long.", "near {F} Road and {F} Lane", "on {town} Avenue", "{F} and Sons, builders", "{F} & Sons", "{F} & Co.", "{F} Partners, lawyers", "{F} Brothers", "{F} Ltd. of {town}", "{F} GmbH", "{F} Museum", "the {F} Society", "{G} {F} Ltd. went bankrupt.",
    "{F} Hall is old.", "{F} Company", "{F} Station", "the {F} {noun}", "a {F} {noun} from {town}", "{F}, {town} and {town}", "{town}, {F} and {F}", "Mr. {F} left.", "Herr {F} kommt.", "{G} came late.", "{G} and {G} met {G}.", "Dear {G},", "Hello {G}!", "{G}, {G} and {G}", "{G}: yes", "{F}: no", "{G}'s {noun}",
    "{Adj} {Noun}", "{Adj} {Noun}s of {town}", "The {Adj} {Noun}", "{Noun} {Noun}", "{Noun}, {Noun}", "{Noun} And {Noun}", "{Noun} in {town}", "{town} {Noun} Club", "{town}, {town}", "{town} And {town}", "{Noun}\n{Noun}", "{Noun}\n{town}", "{n2} {Noun} Tips", "How To Build A {Noun}", "{Noun}s And {Noun}s Of {town}",
    "{NOUN} {NOUN}", "THE {ADJ} {NOUN} OF {TOWN}", "{TOWN} {NOUN}", "{NOUN} AND {NOUN}", "{NOUN}\n{NOUN}", "VOLUME {n1}: {NOUN}", "{NOUN}, {TOWN}", "*** BEGIN {NOUN} {TOWN} ***", "END OF {NOUN} AND {TOWN}", "CHAPTER {n1}\n{NOUN}",
    "Terms And Conditions", "Site Map\n{Noun}", "Older Entries\n{Noun} {Noun}", "{Noun} > {Noun} > {Noun}", "{Noun} | {Noun} | {Noun}", "Edited in {town}\n{Noun} Press", "{Noun} Press, {year}", "{town} University Press", "designed at {Noun} Studio", "Monday Morning", "Saint {Noun}", "North {town}", "Lake {town}",
    "the street was empty", "the way to {town}", "rue barrée", "der Weg ist weit", "una calle larga", "{n2} ways home", "{n1} drive units", "At {n2} Percent", "a road of {n2} miles", "In {n1} Court Cases", "place {n1} of {n2}",
    "{Adj} {Look}", "{Adj} {Look}.", "{Noun} {Look}", "{Look} {Noun}", "{Look} {Look}", "{Look}\n{Noun} {Look}", "{Noun}\n{Look}", "go on with {Adj} {Look}.", "{Noun} | {Look}\n{Noun} {year}", "{NOUN} {LOOK}", "THE {ADJ} {NOUN} {LOOK} OF {TOWN}", "{NOUN} OF THE {NOUN} {LOOK} AND THE {ADJ} {NOUN}", "{NOUN} {LOOK} {NOUN} {NOUN}", "read {Adj} {Look}.", "All about {Adj} {Look}\n", "{LOOK} {NOUN}", "{NOUN}\n{LOOK} {n2}", "{LOOK}\n{Noun} . {n2}", "{Look} Of {town}", "Our {Look} {Noun} in {town}", "{Look}, {Noun} and {Look}", "{Noun}, {Look}",
    "Whereas the {noun} slept, {town} woke.", "{town} is a {noun} town. Every {Noun} Day brings guests.", "When {town} burned, {town} helped.", "In {town} Nobody Sleeps", "Der {Noun} von {town}", "Le {Noun} de {town}", "El {Noun} de {town}",
]


def _name(r: random.Random, ends: list[str]) -> tuple[str, str, str]:
    g = r.choice(GIVEN)
    f = r.choice(STEMS) + r.choice(ends)
    return g, f, f"{r.choice(STEMS)}{r.choice(ends)}"


def person(r: random.Random, ends: list[str]) -> str:
    """A person's name in one of its forms."""
    g, f, f2 = _name(r, ends)
    initial = r.choice("ABCDEFGHJKLMNOPRSTW")
    out = r.choices((f"{g} {f}", f"{f}, {g}", f"{g} {initial}. {f}", f"{initial}. {f}", f"{g} {f}-{f2}", f"{f}, {initial}."), (50, 14, 12, 12, 8, 4))[0]
    return out.upper() if r.random() < 0.08 else out.replace(" ", "\n", 1) if r.random() < 0.05 else out


def email(r: random.Random, ends: list[str]) -> str:
    """An address, plain or disguised."""
    g, f, _ = _name(r, ends)
    user = r.choice((f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}{r.randint(2, 99)}", f"{g}-{f}+{r.choice(NOUNS)}", f"{r.choice(NOUNS)}.{f}", "info", "office")).lower()
    host = r.choice((f"{r.choice(NOUNS)}.org", f"mail.{r.choice(NOUNS)}.net", f"{r.choice(NOUNS)}-{r.choice(NOUNS)}.com", f"{r.choice(NOUNS)}.co.uk"))
    out = r.choices(
        (f"{user}@{host}", f"{user}(at){host}", f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user}[at]{host}"), (55, 10, 12, 10, 8, 5)
    )[0]
    return out.upper() if r.random() < 0.06 else out


def _digits(r: random.Random, n: int) -> str:
    return "".join(str(r.randint(1 if not i else 0, 9)) for i in range(n))


def phone(r: random.Random) -> str:
    """A telephone number in a national or international form of public numbering plans."""
    d = lambda n: _digits(r, n)
    pairs = lambda sep, n=4: sep.join(d(2) for _ in range(n))
    out = r.choice((
        f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1{d(10)}", f"+1 ({d(3)}) {d(3)}-{d(4)}",
        f"020 {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"07{d(3)} {d(6)}", f"+44 {d(4)} {d(6)}", f"+44 20 {d(4)} {d(4)}", f"+44 (0)20 {d(4)} {d(4)}",
        f"+49 {d(2)} {d(5)}{d(3)}", f"+49 {d(3)} {d(7)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(7)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(2)}-{d(8)}",
        f"+33 {d(1)} {pairs(' ')}", f"0{d(1)} {pairs(' ')}", f"0{d(1)}.{pairs('.')}", f"0{d(1)}{d(8)}", f"+34 {d(3)} {d(3)} {d(3)}", f"9{d(2)} {pairs(' ', 3)}", f"+34 {d(3)} {pairs(' ', 3)}",
    ))
    return f"{out} {r.choice(('ext.', 'x', 'ext'))} {r.randint(10, 999)}" if r.random() < 0.06 else out


def id_number(r: random.Random) -> str:
    """A social security or insurance number, passport or identity card number of public formats."""
    d = lambda n: _digits(r, n)
    big = "ABCDEFGHJKLMNPRSTXYZ"
    two = r.choice((f"{r.choice(big)}{r.choice(big)}", "QQ"))
    return r.choices(
        (f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{two} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{two}{d(6)}{r.choice('ABCD')}", f"{r.choice(big)}{d(7)}", f"{r.choice(big)}{d(8)}", f"{r.choice('LCTX')}{d(2)}{r.choice(big)}{d(5)}", f"{d(3)} {d(3)} {d(3)}", f"{d(8)}-{r.choice(big)}", f"{d(8)}{r.choice(big)}"),
        (22, 10, 12, 12, 10, 8, 9, 8, 9, 4),
    )[0]


def code(r: random.Random) -> str:
    """A number of an order, part, invoice or the like: groups of digits of any sizes."""
    sep = r.choice("--/. ")
    return sep.join(_digits(r, r.randint(1, 7)) for _ in range(r.randint(2, 4)))


def isbn(r: random.Random) -> str:
    """Something like a book number."""
    return r.choice((f"97{r.choice('89')}-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}", f"{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{r.choice('0123456789X')}", f"{_digits(r, 3)}-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 3)}", f"97{r.choice('89')} {_digits(r, 10)}"))


def address(r: random.Random, ends: list[str]) -> str:
    """A street with its house number, sometimes with a flat."""
    n, name = r.randint(2, 2400), r.choice((r.choice(TOWNS), r.choice(STEMS) + r.choice(ends), r.choice(NOUNS).title(), f"{r.choice(ADJECTIVES)} {r.choice(NOUNS).title()}"))
    k = r.random()
    if k < 0.55:
        out = f"{n}{r.choice(('', '', '', 'A', 'B', 'c'))} {name} {r.choice('Street St. St Road Rd Avenue Ave. Ave Lane Close Terrace Drive Way Square Court Crescent Place Boulevard Blvd'.split())}"
        out = f"{r.choice(('Flat', 'Apt', 'Apt.', 'Unit', 'Apartment', 'Suite'))} {r.randint(1, 60)}{r.choice(('', 'A', 'B'))}, {out}" if r.random() < 0.2 else out
    elif k < 0.7:
        out = f"{n % 150 + 1}{r.choice(('', '', ' bis', ','))} {r.choice('rue avenue boulevard impasse place chemin allée quai'.split())} {r.choice(('de la Gare', 'du Château', 'des Lilas', 'Pasteur', 'de l’Église', 'Molière'))}"
    elif k < 0.86:
        out = f"{r.choice('Bahnhof Schul Kirch Wiesen Rosen Berg Haupt'.split())}{r.choice(('straße', 'strasse', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ring', 'ufer', 'damm'))} {n % 150 + 1}{r.choice(('', '', 'a'))}"
    else:
        out = f"{r.choice(('Calle', 'Plaza', 'Avenida', 'Paseo', 'Camino'))} {r.choice(('Real', 'de la Luna', 'del Sol', 'de los Olivos', 'Goya'))}{r.choice((' ', ', '))}{n % 150 + 1}"
    return out.upper() if r.random() < 0.05 else out.replace(" ", "\n", 1) if r.random() < 0.03 else out


def fill(r: random.Random, template: str, ends: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """A template's text and its mentions."""
    mentions = {"P": lambda: person(r, ends), "E": lambda: email(r, ends), "T": lambda: phone(r), "I": lambda: id_number(r), "A": lambda: address(r, ends)}
    noun, adjective, town = lambda: r.choice(NOUNS), lambda: r.choice(ADJECTIVES), lambda: r.choice(TOWNS)
    clock = lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}"
    date = lambda: r.choice((f"{r.randint(1950, 2025)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2025)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2025)}"))
    small = {
        "noun": noun, "Noun": lambda: noun().title(), "NOUN": lambda: noun().upper(), "adj": lambda: adjective().lower(), "Adj": adjective, "ADJ": lambda: adjective().upper(), "town": town, "TOWN": lambda: town().upper(), "verb": lambda: r.choice(VERBS), "Look": lambda: r.choice(LOOKALIKES), "LOOK": lambda: r.choice(LOOKALIKES).upper(),
        "F": lambda: r.choice(STEMS) + r.choice(ends), "G": lambda: r.choice(GIVEN), "L2": lambda: "".join(r.choice("ABCDEFGHKL") for _ in "xx"), "code": lambda: code(r), "isbn": lambda: isbn(r), "year": lambda: str(r.randint(1700, 2025)), "time": clock, "date": date,
    }
    text, marks, at = "", [], 0
    while at < len(template):
        if template[at] != "{":
            text += template[at]
            at += 1
            continue
        to = template.index("}", at)
        key, at = template[at + 1 : to], to + 1
        if key in mentions:
            made = mentions[key]()
            marks.append((len(text), len(text) + len(made), KINDS[key]))
            text += made
        else:
            text += _digits(r, int(key[1:])) if key[0] == "n" and key[1:].isdigit() else small[key]()
    return text, marks


def labelled(
    family_ends: list[str], rows: int = 3000, seed: int = 3, templates: list[str] = TEMPLATES, harmless: list[str] = HARMLESS
) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str], set[str]]:
    """(texts with their mentions, known given names, known family names); about half of the names are known.

    ``family_ends`` are the endings that family names take, from the name lexicon.
    """
    r = random.Random(seed)
    ends = family_ends or ["son"]
    out = []
    for _ in range(min(rows, MAX_ROWS)):
        text, marks = "", []
        for _ in range(r.randint(1, 3)):
            made, found = fill(r, r.choice(templates if r.random() < 0.55 else harmless), ends)
            marks += [(len(text) + a, len(text) + b, k) for a, b, k in found]
            text += made + r.choice((" ", "\n", "\n\n"))
        out.append((text, marks))
    given = {g for i, g in enumerate(GIVEN) if i % 5 < 3}
    family = {s + e for i, s in enumerate(STEMS) for j, e in enumerate(ends) if (i * 7 + j * 3) % 10 < 6}
    return out, given, family
