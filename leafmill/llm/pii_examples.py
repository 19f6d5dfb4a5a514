"""A small labelled table of personal data for the field, made by rule: carrier phrases with slots, and ways of writing
an address, a phone number, an IP or a card, most of which the fixed patterns miss. A share of the phrases is kept
back for measuring (``held=True``): neither their wording nor their values are trained on."""

from __future__ import annotations

import random

NAMES = ["anna", "ben", "carlos", "dana", "emil", "fiona", "goran", "hanna", "ivan", "jose", "karin", "lena", "marco", "nina", "olga", "paul", "rosa", "sven", "tina", "viktor"]
HOSTS = ["mail", "post", "example", "office", "firma", "correo", "poste", "campus", "studio", "verlag"]
ENDS = ["com", "org", "net", "de", "fr", "es", "edu"]

#: Carrier phrases by kind; {} is the place of the value. The last of each kind are kept back.
CARRIERS = {
    "email": [
        "please write to {} for details", "mail : {} .", "contact {} or come by", "you can reach her at {} any time", "send it to {} , thanks", "email {}",
        "my address is {} and his is not", "schreiben sie an {} bitte", "escriba a {} por favor", "notre adresse {} est nouvelle", "( {} )", "questions go to {} first",
        "he signed with {} below", "write {} if in doubt", "antworten an {} genügen", "to : {}",
    ],
    "phone": [
        "call {} before noon", "phone {} .", "tel. {} , ask for the office", "my number is {} now", "fax {} or letter", "dial {} and wait", "mobile : {}", "ring {} at night",
        "telefon {} ab acht uhr", "llame al {} por favor", "appelez le {} ce soir", "( tel {} )", "his phone , {} , was off", "call us on {}", "tel : {}", "number {} answers",
    ],
    "ip": [
        "the server {} is down", "ping {} twice", "host {} answered", "login from {} was refused", "address {} is blocked", "connect to {} first", "der rechner {} antwortet",
        "from ip {} at night", "the router at {} restarts", "ip : {}",
    ],
    "card": [
        "charge card {} today", "card number {} expires", "pay with {} please", "visa {} was declined", "karte {} ist gesperrt", "la tarjeta {} es nueva", "carte {} refusée",
        "my credit card {} was stolen", "the card {} is valid", "card : {}",
    ],
}

#: Phrases with numbers and marks that are no personal data; # is a digit, @ and + stand for themselves.
PLAIN = [
    "length ## . # m", "depth ### . ## mm today", "# . ## . # is the mark", "### - ### pages", "## / ## / ## were the sides", "rows ## ## ## ##", "## . ## . ## is a date", "lines ### . ### of it",
    "a rate of # . ### per day",
    "in the year #### it rained", "chapter ## , page ###", "it costs ##.## in all", "about ### people came", "version #.#.# is out", "on ##.##.#### at ##:##", "section #.# says so",
    "#### or #### of them", "room ### on floor #", "from ##:## to ##:##", "a total of #,###,###", "##% of ####", "between #### and ####", "point ( # ) and point ( ## )", "size ## x ## x ##",
    "grew by +##% in ####", "at least ## and at most ###", "isbn ###-#-###-#####-#", "order no. ####### was sent", "born on ####-##-##", "## + ## makes ###", "@ noon we met", "item ##### , lot ##",
    "score ##:## after ## minutes", "the first # of ## dots", "a dot on the map", "dot by dot at dusk", "look at dot ## there", "temperatures of -## to +##", "code ######## in the list", "€ ##.### or $ ##,###",
    "route ### , exit ##", "figure #.## shows ###", "see [##] and [##]", "volume ## ( #### ) , pp. ###-###", "line ### : ####", "chips ### ### ###", "the ## . of march ####", "## dot points", "serial ##########",
    "about ## at ##", "##th of ##", "a + b + #", "#### #### of them", "~##.###", "key ################ is long", "hash ####a##b####c##d#", "population : ## ### ###", "meet @ ## o'clock", "distance ### . ## km",
]


def _digits(rng: random.Random, mask: str) -> str:
    return "".join(str(rng.randrange(10)) if c == "#" else str(rng.randrange(1, 10)) if c == "9" else c for c in mask)


def _card(rng: random.Random) -> str:
    digits = [int(c) for c in rng.choice("3456")] + [rng.randrange(10) for _ in range(14)]
    total = sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def _value(rng: random.Random, kind: str) -> str:
    if kind == "email":
        name = rng.choice(NAMES) + rng.choice(["", "", str(rng.randrange(100)), "." + rng.choice(NAMES), "_" + rng.choice(NAMES)])
        host, end = rng.choice(HOSTS) + rng.choice(["", str(rng.randrange(10))]), rng.choice(ENDS)
        at, dot = rng.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", " . "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", "."), (" AT ", " DOT "), ("{at}", "{dot}")])
        return f"{name}{at}{host}{dot}{end}"
    if kind == "phone":
        masks = ["(9##) ###-####", "9##-###-####", "9##.###.####", "0## 9######", "0### 9######", "0##/9######", "09## 9######", "06 ## ## ## ##", "0## - 9## ## ##", "(0##) 9######", "00## 9# ### ####", "+## ### ######", "+9 (###) ###-####"]
        return _digits(rng, rng.choice(masks))
    if kind == "ip":
        parts = [str(rng.randrange(1, 256)) for _ in range(4)]
        return rng.choice([".", "[.]", " . ", "(.)", "[.]"]).join(parts)
    number = _card(rng)
    fours = [number[k : k + 4] for k in range(0, 16, 4)]
    return rng.choice([".", "/", "_", "--", " - ", "", " "]).join(fours)


def labelled_table(rounds: int = 12, held: bool = False, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) with (start, stop, kind) of each span. With ``held`` the phrases kept back, filled with other values."""
    rng = random.Random(seed + held)
    rows: list[tuple[str, list[tuple[int, int, str]]]] = []
    for kind, carriers in CARRIERS.items():
        kept = len(carriers) // 4
        own = carriers[-kept:] if held else carriers[:-kept]
        for k in range(rounds * 16):
            before, after = own[k % len(own)].split("{}")
            value = _value(rng, kind)
            rows.append((before + value + after, [(len(before), len(before) + len(value), kind)]))
    kept = len(PLAIN) // 4
    own = PLAIN[-kept:] if held else PLAIN[:-kept]
    for k in range(rounds * 40):
        text = _digits(rng, own[k % len(own)])
        cut = rng.choice(["", "and so ", "then , ", "the end . "])
        rows.append((cut + text, []))
    return rows
