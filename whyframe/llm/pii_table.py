"""The small labelled table that the personal-data tagger learns from: invented lines with marked spans.

Lines are made by rule from patterns of what is personal data and of what only
looks like it. In a pattern ``d`` is a digit, ``o`` a number up to 255, ``h`` a
hexadecimal digit, ``w`` a word of a name, and ``L`` the digit that makes the
digits of its span pass the Luhn check.
"""

from __future__ import annotations

import random

from .pii import KINDS, luhn_digit

# Ways to write each kind.
WRITTEN = {
    "email": ["W@W.com", "W.W@W.org", "W.DD@WD.W.com", "W+W@W.co.uk", "W_W@W-W.de", "WDD@W.W.net", "ü-W@Wö.de", "W@Wé.fr"],
    "ip": ["O.O.O.O", "O.O.O.O", "O.O.O.O", "DDHH:HDHD::DHHD", "HHDD:DHD:HDH:D::D", "fe80::DHH:HDHH:DHD:DHHD"],
    "card": ["4DDDDDDDDDDDDDDL", "4DDDDDDDDDDDDDDL", "5DDDDDDDDDDDDDDL", "4DDD DDDD DDDD DDDL", "5DDD-DDDD-DDDD-DDDL", "4DDD.DDDD.DDDD.DDDL", "3DDD DDDDDD DDDDL", "4DDD/DDDD/DDDD/DDDL"],
    "phone": ["+1 (DDD) DDD-DDDD", "+1 (DDD) DDD-DDDD", "+DD DDD DDDDDDD", "+DD-DD-DDDD-DDDD", "(DDD) DDD-DDDD", "DDD-DDD-DDDD", "DDD.DDD.DDDD", "1-800-DDD-DDDD", "00DD DDD DDDDDD", "+DDDDDDDDDDD", "0DD DDDD DDDD", "+DD (0)DD DDDD DDDD"],
}
# Numbers and signs that are nobody's data.
OTHER = ["20DD-0D-1D", "1D.0D.20DD", "0D/1D/19DD", "1D:3D:0D", "20DD-0D-1DT1D:0D", "$D,DDD.DD", "DD.D%", "D.D.D", "vD.DD.D", "19DD-19DD", "DD-DD", "D + D = DD", "DD DD DD DD", "DDD DDD DDD", "D.DDDD, DD.DDDD", "@W", "W@W", "#DDDDD", "DDDDDDDDDDDDDDDDDDDDDD", "HDHHDDHDHHHDHDDH", "token = \"HDHHDDHDHHHDHDDHHDHD\"", "password=HDHHDDHD", "978-D-DD-DDDDDD-D", "(D)", "[DD]", "D,DDD,DDD", "DDD", "DDDD", "DDDDD", "Dth", "WD", "Q3 20DD", "DD kg", "D x D", "- D -", "D/D", "DD:DD", "10^D", "W/W.W?x=DD", "DDDD-DDDD", "D.DD.DDD.DD.D", "§ D", "DDDDDDD", "DDDDDDDDDD"]
NAMES = ["anna", "lee", "omar", "kim", "jo", "mail", "host", "example", "novak", "site", "rosa", "li", "max", "data"]
WORDS = ["the", "and", "please", "of", "das", "pour", "los", "Ihre", "reach", "from", "at", "see", "then", "oder", "chez", "con"]
BEFORE = {"email": ["mail", "write", "contact"], "ip": ["host", "server", "from"], "card": ["card", "visa", "paid"], "phone": ["phone", "call", "tel", "fax"], None: ["page", "order", "version", "about", "since", "ISBN"]}
MARKS = ["", "", "", "", ".", ",", ";", ")", "!"]


def _spell(rng: random.Random, pattern: str) -> str:
    out = ""
    for c in pattern:
        out += str(rng.randrange(10)) if c == "D" else str(rng.randrange(256)) if c == "O" else rng.choice("0123456789abcdef") if c == "H" else rng.choice(NAMES) if c == "W" else luhn_digit(out) if c == "L" else c
    return out


def labelled_lines(rows: int = 900, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(line, spans as (kind, start, end)) of invented lines, the same for the same arguments."""
    rng, out = random.Random(seed), []
    for _ in range(rows):
        line, spans = " ".join(rng.choices(WORDS, k=rng.randrange(3))), []
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            kind = rng.choice([*KINDS, None, None, None, None])
            if rng.random() < 0.5:
                line += " " + rng.choice(BEFORE[kind] if rng.random() < 0.5 else WORDS) + rng.choice(["", "", ":"])
            line = line + " " if line else ""
            if rng.random() < 0.08:
                line += rng.choice("(<[\"")
            value = _spell(rng, rng.choice(WRITTEN[kind] if kind else OTHER))
            if kind:
                spans.append((kind, len(line), len(line) + len(value)))
            line += value + rng.choice(MARKS)
        if rng.random() < 0.5:
            line += " " + rng.choice(WORDS)
        out.append((line, spans))
    return out
