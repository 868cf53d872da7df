"""Names of people in free text, by a linear model over candidates.

Candidates are words that could be a name by their form alone: two or three capitalised words (with
initials or particles), the same in capitals, "Last, First", a title and a word, a common first
name with whatever follows it. A logistic regression decides by form, position, neighbouring
words, endings, and what is known of the words. It is fitted when first used, on the labelled
sample below: sentences written for it, whose slots are filled with names from the lists below (half of
the first names from the common ones) and with invented ones. The sample is bounded: COPIES fillings
of each sentence. Neither sentences nor names are taken from the data the model is used on, but reading its errors there told
which kinds of sentence to add.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp

#: Fillings of each labelled sentence: with about 370 sentences the model sees some 8,500 texts; one without a slot comes half as often.
COPIES = 30
EPOCHS = 4
#: Share of its candidates in which a word is hidden from the model.
HIDDEN = 0.3
#: From here on a first name is invented, and so is this share of surnames.
INVENTED = 0.65
SEED = 7
#: Log-odds from which on a candidate is a name; below 0 because a name left in a text is worse than a word lost.
LEAST_SCORE = -0.5

# Common first names of the languages at hand, by gender: a feature of the model, and the gender of a surrogate.
FEMALE = """alice amelie amina ana andrea angela anna anneke annette beatrice bettina birgit camille carla carmen carolina caroline catherine cecile celia chiara
christine clara claire claudia cristina diana dolores elena elisa elise elizabeth emilia emily emma esther eva fatima florence francesca frieda gabriela gerda gisela
giulia greta hanna hannah heike helen helena ines inga ingrid irene irina isabel jana jane jessica joanna julia julie karin karla katharina laura lea leila lena linda
lisa louise lucia lucie luisa margaret maria marie marion marta martina mia michelle mila monika monique nadia nadine natalia nina noemi noor nora olga olivia patricia paula petra
pilar priya rachel rebecca rosa ruth sabine sandra sara sarah silke silvia simone sofia sonja sophie susanne svetlana sylvie teresa ursula valerie vera veronika wanda yasmin zoe""".split()  # fmt: skip
MALE = """adam ahmed alain albert alejandro alexander ali andreas andrew antoine antonio arthur axel ben bernd bruno carl carlos charles christian christoph daniel david denis
diego dieter dmitri edgar eduardo emil emilio enrique erik ernst fabio felix fernando florian francisco frank franz frederic friedrich georg george gerard gregor guido
gustav hans harald hassan heinz henri henry hugo igor ivan jacques james jan javier jean joachim johann john jonas jorge jose joseph juan juergen karl klaus kofi konrad
kurt lars leo liam louis luca lucas luis lukas manfred marc marcel marco mario markus martin mateo matthias max michael michel miguel mohammed nicolas oliver omar oscar
otto pablo paolo patrick paul pedro peter philipp pierre quentin rafael ralf raul richard robert rolf ruben samir samuel sebastian sergio simon stefan tariq thomas tim
tomas ulrich viktor walter werner wilhelm william xavier yusuf""".split()  # fmt: skip
GENDER = {n: "f" for n in FEMALE} | {n: "m" for n in MALE}
TITLES = frozenset("mr mrs ms miss mx dr prof herr frau mme mlle madame monsieur sr sra srta señor señora doña dra".split())
PARTICLES = frozenset("de da di do dos del della la le van von der den ter zu al el bin ibn ben".split())

# Names that only fill the sample, so that the model does not lean on the common ones.
OTHER_FIRST = """Aarav Abena Adaeze Agnieszka Aisling Akira Anjali Arjun Aurelio Ayse Bartosz Beatriz Bjorn Caoimhe Chidi Chinwe Dagmar Deepak Desmond Divya Eamon Ebony Eszter
Fergus Fiona Gideon Goran Gwen Haruto Hilde Hiroshi Idris Ilse Imran Isolde Jaap Jamila Jarek Kaito Kavita Keiko Kenji Kirsten Lakshmi Layla Lorcan Magda Malik Meera Mehmet Mei Milos Nasrin
Ngozi Niamh Nkechi Oluwaseun Oskar Padma Piotr Rajesh Rashid Ravi Rohan Rosalind Sakura Sanjay Seamus Sinead Soren Sunita Takumi Tomasz Uche Vikram Wangari Xiaoming Yuki Yasuko Zainab Zoltan Bea Thandiwe""".split()  # fmt: skip
SURNAMES = """Abara Achterberg Adeyemi Aguilar Baumgartner Bellini Bhatt Blackwood Bjerregaard Calloway Castellanos Chaudhry Chen Delacroix Dubois Eriksen Farquhar Feng Fitzgerald Fontaine
Gallagher Ghosh Goldblum Gonzalez Gupta Haugen Herrmann Ibarra Ivanova Jensen Joshi Kaczmarek Kamau Kaur Kowalczyk Krishnan Lefebvre Lindqvist Liu MacAllister Marchetti Mbeki
McIntyre Mehta Moreau Mukherjee Nakamura Navarro Ng Nguyen Novak Nwosu O'Brien O'Neill Okafor Okonkwo Olsson Ortega Osei Papadopoulos Park Patel Pereira Petrov Quispe Rasmussen Reddy
Rosenthal Rossi Saito Sandoval Schneider Schröder Sharma Silva Singh Soto Sørensen Szabo Takahashi Tanaka Thibault Tran Vandenberg Villanueva Watanabe Weiss Whitfield Wójcik Wu
Xu Yamamoto Yilmaz Zhao Zimmermann Stoneham Ashworth Thornbury Larkspur Hartwell Bergstrom""".split()  # fmt: skip

# Labelled sample. {} is a name in any of its forms; <> one that is written with a capital, without a title. Everything else is no name.
SAMPLE = """
Ask {} before you change this.
Please call {} first, the line is often busy.
Contact {} for access
contact: {}
Owner: {}
owner is {}
Belongs to {}.
The account belongs to {} and is shared.
Set up by {} in March.
Created by {} last year
Recovery codes are with {}.
{} has the second key.
{} knows the answer to the question.
{} keeps the spare card in the office.
{} (evenings only)
Speak with {} about the invoice
Old login of {}, do not use
Handed over to {} on Tuesday.
Transferred from {} after the move.
Send the letter to {}, ground floor.
Card in the name of {}
Cardholder {}
Registered for {}.
Login shared between {} and {}.
Managed by {}; backup is {}.
Signed, {}
Thanks to {} this works again.
Emergency contact {}, see the list.
Reset only with {} on the phone.
Phone number of {} is in the binder.
The PIN was chosen by {}.
According to {} the old server stays.
Invoice goes to {}
c/o {}
cc {} on every mail
Tell {} when it expires
This one is for {} only.
My colleague {} set the reminder.
The manager, {}, approved it.
Landlord {} wants a copy.
doctor: {}
Reach {} at the usual number.
meeting with {} on Thursday
{}
{}, second floor
{} - main user
- {}
- ask {}
Best regards\n{}
Dear {}, please renew this.
Our accountant {} files the forms.
Paid by {} with the company card.
Ansprechpartner: {}
Ansprechpartnerin ist {}.
Bitte {} fragen.
Vor der Änderung {} anrufen.
Konto gehört {}.
Zugang von {} übernommen.
{} hat den Schlüssel.
{} kennt die Antwort.
Eingerichtet durch {} im Mai.
Rückruf bei {} erbeten
Im Notfall {} verständigen.
Der Vertrag läuft auf {}.
Inhaber {}
Rechnung geht an {}.
Passwort liegt bei {}.
Vertretung: {}
Mit {} besprochen
Weitergegeben an {} am Montag.
Unterschrieben von {}
Kontakt {}, nur vormittags
Für {} hinterlegt
Contact : {}
Demander à {} avant tout changement.
Appeler {} en cas de doute.
{} a la clé de secours.
{} connaît la réponse.
Compte de {}, ne pas fermer.
Le compte appartient à {}.
Créé par {} en mai.
Au nom de {}
Titulaire {}
Remis à {} lundi.
Voir avec {} pour la facture
Facture envoyée à {}.
Transmis par {} après le départ.
Propriétaire : {}
La carte est chez {}.
Preguntar a {} antes de cambiar.
Llamar a {} si hay dudas.
{} tiene la llave.
{} sabe la respuesta.
Cuenta de {}, no cerrar.
La cuenta pertenece a {}.
Creado por {} en mayo.
A nombre de {}
Titular: {}
Titular {}
Entregado a {} el lunes.
Contacto: {}
Hablar con {} sobre la factura
Factura enviada a {}.
La tarjeta la guarda {}.
Propietario: {}
{} wrote this down in the meeting.
{} uses it at home, too.
{} was here before the audit.
{} needs a new card in autumn.
{} works from the second floor.
{} and {} both have access.
As {} said, the old one is gone.
Until {} is back, use the spare.
After {} left we closed it.
Because {} lost the phone
When {} calls, read the code aloud.
Borrowed from {} for the trip.
Opened by {} at the counter.
Checked by {} twice.
Sent to {} by post.
Bought through {} in the city.
Replaced at the request of {}.
On behalf of {}
In memory of {}
Translated by {}
The tenant is {}.
The card shows {}.
Written for {} and nobody else.
Do not give it to {}.
Wait for {}, then restart.
Found by {} under the desk
desk of {}
user: {}
name: {}
holder = {}
Admin {}
Attn {}
with {}
for {}
by {}
from {}
{}: second key, first drawer
{} / front desk
{} left in April.
{} will decide.
{} can unlock it.
{} does not answer after six.
{} zahlt den Beitrag.
{} nutzt das auch daheim.
{} war vor der Prüfung hier.
Laut {} bleibt alles so.
Auf Wunsch von {} gesperrt.
Durch {} geprüft
An {} senden
Bei {} nachfragen
Der Mieter heißt {}.
Solange {} fehlt, die Kopie nehmen.
Name: {}
{} paie la cotisation.
{} utilise aussi la copie.
Selon {}, rien ne change.
Bloqué par {} hier.
Envoyer à {}
Avec {}, au premier étage
Le locataire est {}.
Pour {} seulement.
{} paga la cuota.
{} usa también la copia.
Según {}, nada cambia.
Bloqueado por {} ayer.
Enviar a {}
Con {}, primera planta
El inquilino es {}.
Para {} solamente.
The Blue Harbor theme needs the old plugin.
The North Gate entrance is closed.
Silver Vault and Copper Login are products of the same firm.
Green Portal was renamed last year.
Quick Notes keeps a copy of this.
Smart Wallet asks for a code.
Night Vault syncs every hour.
Web Vault keeps the old files.
Cloud Box keeps old versions.
Travel Portal has the tickets.
Smart Home knows the answer.
Paper Trail has its own login.
Harbor Mail keeps its own list.
Family Plan ends in June.
Home Office license, two seats.
Open Office documents need the Data Manager plugin.
Customer Service is closed on Sunday.
Central Bank holiday on Friday.
Main Square kiosk sells the card.
Old Town branch has moved.
The High Street branch has moved.
River Street parking permit
Street Map layer must be on.
The Garden Road exit is closed.
Rosa Parks Avenue is the last stop.
Anna Freud Street has no parking.
Victor Hugo Square is the last stop.
Maria Theresa Road is closed.
Thomas Mann Library card
Bruno Kreisky Park gate code
Karl Marx Allee ist gesperrt.
Otto Wagner Platz, dritter Eingang
Martin Luther Kirche, Seiteneingang
Marie Curie Gymnasium, Zimmer im Keller
Rue Victor Hugo fermée
Place Jeanne Hachette fermée
Plaza Mayor cerrada
Calle Mayor cerrada
Hospital San Carlos, planta baja
Black Friday offer
Happy Birthday card from the shop
Google Play and App Store purchases
Microsoft Teams needs the Work Profile.
Apple Pay is off, Face ID too.
Visual Studio license
Windows Server admin
Linux Mint laptop
Premium Plus account
Silver Tier member since May.
New York office uses another key.
San Francisco server
Los Angeles warehouse
Hong Kong branch
Berlin Mitte office
Madrid Norte depot
Lisbon team has its own tenant.
Paris Nord depot
United Kingdom only
South Africa shop
Monday and Friday backups
Every Monday, Wednesday and Friday
The April release broke it.
March invoice is paid.
Security Question is the name of the street.
Two Factor is off.
Secret Key below
Master Password is in the safe.
Recovery Phrase below
Serial Number is on the back.
Access Code changes in January.
Voucher Code expired.
Order Number and Customer Number are in the mail.
Bank Account is closed.
Username is the mail address.
Password was changed after the breach.
Token expires in May.
Locker key hangs in the kitchen
Room on the left, desk by the window
Router and Switch are in the rack.
Admin Console is behind the proxy.
Build Server and Test Server share the key.
Release Notes say so.
Icon file must not be renamed.
Browser Extension fills this form twice.
Login moved to the new site.
Ask in the Support Channel first.
Ask Support before you change this.
Contact Support for access
Contact Customer Care, not us.
Call Help Desk first
Call Reception first, the line is often busy.
Send the letter to Head Office, ground floor.
Belongs to Finance Team.
Managed by Operations Team; backup is Night Shift.
Set up by Facility Management in March.
Registered for Early Access.
Invoice goes to Accounts Payable
The account belongs to Marketing and is shared.
Owner: Web Team
Owner: Marketing
contact: Service Desk
cc Sales Team on every mail
Old login of Web Shop, do not use
Recovery codes are with Legal Department.
TODO: merge with Old Entry
NOTE: Do Not Delete
DO NOT DELETE
READ ONLY
OLD ACCOUNT
HIGH PRIORITY
API KEY below
Hash Value below
North Wing, Level Three
Grace Period is two weeks.
Grace period ends in June.
Will Call desk has the ticket.
Mark as read.
Mark As Favorite again
Rose Garden gate
Rich Text mode only
Victoria Station locker
Summer House wifi
Guest Wifi in the Garden House
Kundennummer angeben.
Rechnung wurde bezahlt.
Alte Rechnung im Ordner.
Neuer Wert nach der Prüfung.
Zweiter Zugang im Tresor.
Antwort auf die Frage im Ordner.
Passwort alle Monate ändern.
Zimmer im Keller, dritter Tisch.
Fach im Schrank links.
Konto bleibt offen.
Vertrag endet im Mai.
Gilt nur für die Testumgebung.
Läuft im Juni ab.
Deutsche Bahn Konto
Rotes Kreuz Spende
Neue Adresse ab Mai
Bitte Kundendienst fragen.
Ansprechpartner: Technischer Dienst
Kontakt Zentrale, nur vormittags
Rechnung geht an Buchhaltung.
Blauer Ordner im Regal
Im Notfall Hausmeister verständigen.
Ausweis liegt im Tresor.
Erster Stock, Zweite Tür
Der Drucker Erdgeschoss ist defekt.
Das Konto Sparbuch bleibt offen.
Bitte den Ordner Rechnungen leeren.
{} hat den Zweitschlüssel Alte Karte liegt im Tresor.
{} hat die Karte Gültig bis Juni
Der Zweitschlüssel liegt im Büro.
Wir nutzen den Dienst Mobil Plus.
Das Gerät steht im Raum Nordsee.
Red Lamp means it is charging.
Iron Gate was painted.
Magic Link expires.
Public Holiday on Monday
Second Factor was reset at the request of Head Office.
Until Spring Break, use the spare.
Sent to Postal Box by mistake.
Bought through Partner Shop in the city.
The tenant is Lake View.
with Extended Warranty
for Internal Use only
by Registered Mail
from Old System
user: Guest
name: Test Account
Admin Panel
Attn Shipping Department
Remote Desktop needs the token.
Private Cloud will move in winter.
Gold Card can be used abroad.
Paper Copy was checked twice.
Local Branch does not answer after six.
First Aid kit under the desk
Upper Deck locker
Fire Exit code
Corner Cafe wifi
City Library, upper floor
North Sea ferry
Lake House keys
West Wing printer
Daily Report at noon
Annual Fee was paid.
Gift Card from the shop
Student Discount ends.
Laut Hausordnung bleibt alles so.
Durch Technik geprüft
An Zentrale senden
Bei Versand nachfragen
Name: Testkonto
Grüne Karte gesperrt
Alter Schlüssel im Büro
Freies Wlan im Garten
Großer Saal, linke Tür
Beitrag wird im Herbst fällig.
Selon Règlement Intérieur, rien ne change.
Envoyer à Service Courrier
Petit Bureau, porte gauche
Carte Jeune annulée
Según Reglamento Interno, nada cambia.
Enviar a Oficina Central
Tarjeta Joven anulada
Puerta Norte cerrada
Ancien compte, à garder.
Nouvelle adresse dès mai
Le Grand Hôtel garde la clé.
Carte Bleue expirée
Service Client fermé le lundi.
Crédit Agricole, compte joint
Bureau Paris Nord fermé.
Salle du fond, bureau à gauche.
La réponse est dans le classeur.
Contact : Service Technique
Demander à Service Client avant tout changement.
Numéro de client dans le mail.
Valable pour le site seulement.
Utiliser le jeton rouge.
Cuenta antigua, guardar.
Nueva dirección desde mayo
El Gran Hotel guarda la llave.
Banco Central cerrado el lunes.
Servicio Técnico cerrado.
Contacto: Atención Cliente
Preguntar a Soporte antes de cambiar.
Sala del fondo, mesa a la izquierda.
La respuesta está en la carpeta.
Número de cliente en el correo.
Solo vale para la tienda.
Usar la ficha roja.
Valor anterior cambiado.
""".strip().split("\n")  # fmt: skip

# Lines without names, put before and after others as notes are: on lines of their own, or run together.
PLAIN = [line for line in SAMPLE if "{}" not in line and "<>" not in line]
_JOINTS = (" ", " ", "\n", "\n- ", ". ")

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_NAME_WORD = re.compile(_WORD)
# Words that belong together: single blanks, "X. " initials, or one comma, on one line.
_CHAIN = re.compile(rf"(?<![\w@+.-]){_WORD}(?:\.?,?[  ]{_WORD})*")
_MADE = [("b", "br", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w", "z"), ("a", "e", "i", "o", "u", "ei", "ou"), ("l", "m", "n", "nd", "r", "rg", "s", "ck", "tt", "ll", "st")]
_ENDS = ("er", "man", "ez", "ov", "son", "ski", "i", "a", "ard", "wood", "ton", "", "", "")


def _case(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"


def candidates(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end, form, words) of what could be a name by its form. A form is the order and the case."""
    for chain in _CHAIN.finditer(text):
        words = [(m.start(), m.end(), m[0], _case(m[0])) for m in _NAME_WORD.finditer(text, chain.start(), chain.end())]
        n = len(words)
        if n == 1 and words[0][2].lower() not in GENDER:
            continue
        for i, (a, b, w, case) in enumerate(words):
            low = w.lower()
            if low in TITLES:
                if case != "lower" and i + 1 < n and text[b : words[i + 1][0]].strip(".  ") == "" and words[i + 1][2].lower() not in PARTICLES:
                    end = i + 1
                    yield a, words[end][1], "titled:" + words[end][3], [words[end][2]]
                    if end + 1 < n and text[words[end][1] : words[end + 1][0]] in (" ", " ") and words[end][2].lower() in GENDER:
                        yield a, words[end + 1][1], "titled2:" + words[end + 1][3], [words[end][2], words[end + 1][2]]
                continue
            known = low in GENDER
            if case == "lower" and not known:
                if i + 1 < n and words[i + 1][2].lower() in GENDER and words[i + 1][3] == "lower" and text[b : words[i + 1][0]] == ", ":
                    yield a, words[i + 1][1], "reversed:lower", [words[i + 1][2], w]
                continue
            if case == "title" and known and i and text[words[i - 1][1] : a] in (" ", " "):
                yield a, b, "lone:title", [w]
            # Further words of one name: initials and particles do not count.
            got, at, j = [w], b, i + 1
            while j < n and len(got) < 3:
                c, d, v, vcase = words[j]
                between = text[at:c]
                if between == ", ":
                    if len(got) == 1 and vcase == case and len(w) > 1 and low not in PARTICLES and (known or v.lower() in GENDER or case == "title"):
                        yield a, d, "reversed:" + case, [v, w]
                    break
                initial = len(v) == 1 and (v.isupper() or case == "lower") and text[d : d + 1] == "."
                if between not in (" ", " ") and not (between in (". ", ". ") and len(text[words[j - 1][0] : at]) == 1):
                    break
                if initial:
                    if len(got) == 1 and known:
                        yield a, d + 1, "initial:" + case, [w]
                elif v.lower() in PARTICLES and len(got) == 1 and j + 1 < n and words[j + 1][3] == case:
                    pass
                elif vcase != case:
                    break
                else:
                    got.append(v)
                    yield a, d, f"full{len(got)}:" + case, list(got)
                at, j = d, j + 1


@lru_cache(maxsize=1)
def plain_words() -> frozenset[str]:
    """Words that the sample uses outside names."""
    return frozenset(w.lower() for line in SAMPLE for w in _NAME_WORD.findall(line.replace("\\n", "\n")))


def features(text: str, start: int, end: int, form: str, words: list[str], hidden: frozenset[str] = frozenset()) -> list[str]:
    """What the model sees of a candidate. A word counts by itself only if the sample uses it outside names;
    of hidden ones not even the ending is seen."""
    kind, case = form.split(":")
    first, last = words[0].lower(), words[-1].lower()
    g = "g" if first in GENDER else "u"
    h = "g" if len(words) > 1 and last in GENDER else "u"
    head = text[max(0, start - 60) : start]
    before = head.rstrip("  \t\"'“«(-*>•")
    place = "line" if not before or before[-1] == "\n" else "sentence" if before[-1] in ".!?" else "colon" if before[-1] in ":=" else "comma" if before[-1] in ",;/" else "mid"
    tail = text[end : end + 30]
    mark = "end" if not tail.strip() else "line" if tail.lstrip(" \t")[:1] == "\n" else tail[:1] if not tail[:1].isspace() else tail.lstrip()[:1] if not tail.lstrip()[:1].isalnum() else "word"
    out = [f"{kind}", f"{kind}:{case}", f"{kind}:{g}{h}", f"{kind}:{case}:{g}{h}:{place}", f"{place}", f"{kind}:{place}:{mark}", f"{mark}"]
    before_words = _NAME_WORD.findall(before) if place != "line" and place != "sentence" else []
    out.append(f"p1={before_words[-1].lower()}" if before_words else "p1=")
    if len(before_words) > 1:
        out.append(f"p2={before_words[-2].lower()} {before_words[-1].lower()}")
    if before_words and before_words[-1][:1].isupper() and place == "mid":
        out.append("p1:capital")
    m = _NAME_WORD.search(tail)
    if m and not tail[: m.start()].strip("  "):
        out += [f"n1={m[0].lower()}", f"n1:{_case(m[0])}", f"{kind}:n1:{_case(m[0])}"]
    common = plain_words()
    plain = [w.lower() in common and w.lower() not in hidden for w in words]
    out += [f"plain={''.join('yn'[not p] for p in plain)}", f"{kind}:plain={sum(plain)}:{g}", f"{kind}:{case}:{place}:plain={sum(plain)}"]
    for at, w, p in (("f", first, plain[0]), ("l", last, plain[-1])):
        if w not in hidden:
            out += [f"{at}3={w[-3:]}", f"{at}2={w[-2:]}"]
        if p:
            out += [f"{at}={w}", f"w={w}"]
    out.append(f"short={min(map(len, words)) < 3}")
    return out


class Model:
    """Logistic regression over the features; what it has never seen weighs nothing."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def score(self, found: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in found])

    def fit(self, rows: list[tuple[list[str], bool]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4) -> Model:
        rnd = random.Random(SEED)
        w = self.weights
        for epoch in range(epochs):
            rnd.shuffle(rows)
            step = rate / (1 + epoch)
            for found, is_name in rows:
                z = self.score(found)
                p = 1 / (1 + exp(-z)) if z > -30 else 0.0
                d = step * (is_name - p)
                for f in found:
                    w[f] = w.get(f, 0.0) * (1 - decay) + d
        return self


def _made(rnd: random.Random) -> str:
    word = "".join(rnd.choice(part) for _ in range(rnd.randint(1, 2)) for part in _MADE) + rnd.choice(_ENDS)
    return word.capitalize()


def _name(rnd: random.Random, plain: bool) -> str:
    x = rnd.random()
    first = rnd.choice(FEMALE + MALE).capitalize() if x < 0.5 else rnd.choice(OTHER_FIRST) if x < INVENTED else _made(rnd)
    last = rnd.choice(SURNAMES) if rnd.random() < 1 - INVENTED else _made(rnd)
    if rnd.random() < 0.04:
        last = f"{rnd.choice(('van der', 'de la', 'von', 'de', 'bin'))} {last}"
    elif rnd.random() < 0.04:
        last = f"{last}-{rnd.choice(SURNAMES)}"
    x = rnd.random()
    if plain or x < 0.5:
        return f"{first} {last}"
    if x < 0.6:
        return f"{first} {rnd.choice('ABCDEFGHJKLMNPRST')}. {last}"
    if x < 0.7:
        return f"{last}, {first}"
    if x < 0.78:
        return f"{first} {last}".upper()
    if x < 0.88:
        return f"{rnd.choice(('Mr', 'Mrs.', 'Ms', 'Dr.', 'Herr', 'Frau', 'Mme', 'Sr.', 'Sra.'))} {last}"
    if x < 0.93 and first.lower() in GENDER:
        return f"{first} {last}".lower()
    if x < 0.95:
        return f"{first} {rnd.choice(OTHER_FIRST)} {last}"
    if x < 0.98 and first.lower() in GENDER:
        return f"{first} {last[0].upper()}."
    return f"{first} {last}"


def sample(copies: int = COPIES, seed: int = SEED) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, places of names): the labelled sample, filled."""
    rnd = random.Random(seed)
    for line in SAMPLE:
        parts = re.split(r"(\{\}|<>)", line.replace("\\n", "\n"))
        for _ in range(copies if len(parts) > 1 else max(1, copies // 2)):
            text, spans = "", []
            if rnd.random() < 0.4:
                text = rnd.choice(PLAIN) + rnd.choice(_JOINTS)
            for part in parts:
                if part in ("{}", "<>"):
                    name = _name(rnd, part == "<>")
                    spans.append((len(text), len(text) + len(name)))
                    part = name
                text += part
            if rnd.random() < 0.4:
                text += rnd.choice(_JOINTS) + rnd.choice(PLAIN)
            yield text, spans


def training_rows() -> list[tuple[list[str], bool]]:
    """Features and label of all candidates of the sample. Each word is hidden in a part of them, or the
    model would lean on the words and names of the sample instead of form and context."""
    rnd = random.Random(SEED)
    rows = []
    for text, spans in sample(COPIES):
        names = set(spans)
        for a, b, form, words in candidates(text):
            hidden = frozenset(w.lower() for w in words if rnd.random() < HIDDEN)
            rows.append((features(text, a, b, form, words, hidden), (a, b) in names))
    return rows


@lru_cache(maxsize=1)
def model() -> Model:
    return Model().fit(training_rows())


def find(text: str, fitted: Model, free=lambda a, b: True) -> list[tuple[int, int]]:
    """Places of names, the surest first where they overlap; free tells what is not yet taken."""
    scored = []
    for a, b, form, words in candidates(text):
        if free(a, b) and text[a - 1 : a] not in ("@", "-", "_", "+", "/") and text[b : b + 1] not in ("@", "_", "+", "/"):
            s = fitted.score(features(text, a, b, form, words))
            if s > LEAST_SCORE:
                scored.append((s, a, b))
    if not scored:
        return []
    scored.sort(key=lambda x: (-x[0], x[1], x[2]))
    out: list[tuple[int, int]] = []
    for _, a, b in scored:
        if all(b <= c or a >= d for c, d in out) if len(out) < 64 else True:
            out.append((a, b))
    if len(out) >= 64:  # many in one text: by sweep instead of by pairs
        taken = bytearray(len(text))
        out = []
        for _, a, b in scored:
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b))
    return sorted(out)
