"""The model of names on sentences and names that its sample does not hold."""

import random

from keelstone.llm import personal, persons

# [name]: to be found. None of these first names or surnames is in the lists of the sample.
HELD_OUT = """
call [Wei Zhang] tomorrow
you might try [Priyanka Natarajan] instead
the contract owner was [Siobhan O'Hanrahan]
Ansprechpartner: [Jürgen Mühlbauer]
contact [Kwame Mensah]
[Ursina Caflisch] will pay in May
Passed on by [Tadhg Breathnach] yesterday
Speak to [Mikołaj Zieliński] about the router.
Approved by [Dr. Vanterpool], see the file
[Bronwen Llewellyn-Rees] moved the account
left with [Ximena Etxeberria] at the desk
the shop belongs to [Tomás Urrutia]
Cancelled by [Hyun-woo Baek] on Sunday
[BJORK STEFANSDOTTIR]
- [Oddny Thorvald] (mornings)
Signed up through [Mrs Featherstonehaugh]
Keys: [Ottoline Cholmondeley]
reminder from [Zsofia Hegedus]
In Absprache mit [Friedhelm Kuhlbrodt] geändert
Gehört [Annegret Pfefferkorn]
Auskunft gibt [Herr Schnabelrauch]
Freigabe durch [Gesine Wolkenhauer] nötig
Voir [Aurore Quemeneur] pour le badge
Compte ouvert pour [Yannick Le Goff]
[Ghislaine Abadie] garde la carte
Demander le code à [Corentin Madec]
Pagado por [Iker Zubizarreta]
Avisar a [Begoña Arrieta] en junio
[Rocío Valdivieso] tiene otra copia
billing: [Thaddeus Quarrington]
Shared with [Nkosana Dlamini] and [Refilwe Mokoena]
[Vandersloot, Marijke]
from [Isambard T. Winterbourne], by phone
the letter names [Eilidh Farquharson]
Managed for [Anneliese Rathgeber]
ask [Bartholomew Ives] or [Clementine Osgood]
[Temitope Balogun] set this up
Rückfragen bei [Hartmut Ziegenfuss]
Card of [Leocadia Brzezinski] is kept here
please wake [Solveig Aasen] only in an emergency
""".strip().split("\n")
NO_NAME = """
The Velvet Harbor app keeps its own list.
Maria Callas Road
Winston Churchill Square is closed
Golden Lantern and Crystal Login were merged
The Long Bridge tunnel is closed
Frozen Account, see ticket
Ask Payroll before the transfer
Contact Field Service for access
Old Backup Server
Zurich office has its own tenant
Data Center North
Sunday and Monday only
Login changed in February
Pocket Vault stores the rest
Passwort im Ordner Steuern
Neue Karte bestellt, Alte Karte gesperrt
Drucker im Flur, Toner leer
Gartentor Nummer vier
Bureau Lyon Sud fermé
Ancienne carte annulée
Tarjeta nueva pedida
Banco Popular cerrado
Printer Toner is empty
Delivery Address changes in March
""".strip().split("\n")

# Written after the settings of the model had been chosen on the sentences above, and not used for any choice.
FRESH = """
the fee was waived by [Philippa Trelawney]
could you ring [Obinna Ezekwesili] back
hand the badge to [Marguerite Vauquelin] at noon
our neighbour [Ignatius Pembroke] feeds the cat
[Ravindra Chatterjee] resigned in May
username of [Torvald Kristoffersen]
lent to [Mireille Bouchardon], due in June
Handwerker [Waldemar Strohschneider] kommt später
Abgeholt von [Roswitha Engelbrecht]
laut [Frau Dinkelacker] erledigt
Merci de prévenir [Clothilde Desrosiers]
signé [Fabrice Lemonnier]
Lo tiene [Macarena Olivares]
firmado por [Gonzalo Echeverría]
the visitor was [Sigurd Halvorsen]
[Dashiell Worthington] and [Imogen Fairweather] share one login
refund issued to [Kazimir Dragomirov]
[LYSANDER PRENTICE] only
Approved: [Cressida Vaughan-Hughes]
notes from the call with [Nirmala Venkataraman]
The Winter Palace ticket is inside
Yellow Folder, third shelf
Silent Mode must be off
Bring Your Own Device rules apply
Telefonzentrale Nord anrufen
Offre Spéciale terminée
Cita Previa necesaria
Mountain Bike insurance
Thursday Evening shift
Second Hand Shop voucher
""".strip().split("\n")


def parse(line):
    text, spans = "", []
    for part in line.replace("]", "[").split("["):
        spans += [(len(text), len(text) + len(part))] if line.find(f"[{part}]") >= 0 else []
        text += part
    return text, spans


def test_held_out_names_are_in_no_list():
    known = {w.lower() for w in [*persons.GENDER, *persons.OTHER_FIRST, *persons.SURNAMES]}
    held = {w.lower() for line in HELD_OUT + FRESH for a, b in parse(line)[1] for w in parse(line)[0][a:b].split() if w.strip("., ").lower() not in persons.TITLES}
    assert not held & known


def test_recall_and_precision_on_held_out_sentences():
    for lines, least in ((HELD_OUT + NO_NAME, 0.9), (FRESH, 0.8)):
        found = true = right = 0
        for line in lines:
            text, spans = parse(line)
            got = [(a, b) for a, b, kind in personal.find(text) if kind == "person"]
            found, true, right = found + len(got), true + len(spans), right + len(set(got) & set(spans))
        print(f"recall {right / true:.3f}, precision {right / found:.3f} of {true} names")
        assert right / true >= least and right / found >= least


def test_recall_and_precision_on_sample_held_back():
    """Fitted on two thirds of the sentences, judged on the others, with invented surnames."""
    rnd = random.Random(3)
    lines = list(persons.SAMPLE)
    rnd.shuffle(lines)
    kept, saved = lines[: 2 * len(lines) // 3], persons.SAMPLE
    try:
        persons.SAMPLE = kept
        fitted = persons.Model().fit(persons.training_rows())
        persons.SAMPLE = [x for x in saved if x not in kept]
        found = true = right = 0
        for text, spans in persons.sample(seed=99):
            got = persons.find(text, fitted)
            found, true, right = found + len(got), true + len(spans), right + len(set(got) & set(spans))
    finally:
        persons.SAMPLE = saved
    print(f"recall {right / true:.3f}, precision {right / found:.3f} of {true} names")
    assert right / true >= 0.85 and right / found >= 0.85


def test_model_is_the_same_each_time():
    a, b = persons.model(), persons.model.__wrapped__()
    assert a.weights == b.weights


def test_edges():
    assert persons.find("", persons.model()) == [] and personal.find("\n\n - ") == []
    assert [("Dr. Strudbrook")] == [t[a:b] for t in ["see Dr. Strudbrook"] for a, b in persons.find(t, persons.model())]


def test_surrogates_meet_no_listed_word():
    s = personal.Surrogates("k")
    low = [a + b + c for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"]
    names = [w for w in low if w not in persons.GENDER and w not in persons.TITLES]
    made = {s._name(w) for w in names}
    assert len(made) == len(names) and not made & set(persons.GENDER) and not made & persons.TITLES
    words = [w for w in low if w not in s.KEPT]
    made = {s._street(w) for w in words}
    assert len(made) == len(words) and not made & s.KEPT
    assert len(made | {s._street(w) for w in words}) == len(words)
