"""Candidates for personal information in one text: spans with the terms and contexts the corpus judges them by.

Candidates come from form alone: every pair of capitalised words or of an initial
and such a word, every number of enough digits, every address-like line, every
written-out address of mail. No list says which words are names and no sentence frame says where they
stand. Only what states the kind by itself seeds the counts: a title, a mailbox
(``Given Surname <address>``) or a trailer's label before or after a name, a label word or a country code
before a number, a sign @ in an address of mail, a postal code in a street address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Candidate(NamedTuple):
    kind: str  # email, number, address, name
    start: int
    end: int
    seed: str  # the kind that the text states, or ""
    terms: list[str]  # what is disclosed: name parts, the shape of a number, the town and form of an address, the host of an address of mail
    contexts: list[str]  # one token to the left, two to the left, one to the right, two to the right
    closed: str = ""  # whether something closes a town's name
    second: str | None = None  # the town's second word
    short_end: int = 0  # end without the town's second word


_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİŁŃŇŐŘŚŞŠŢŤŪŮŰŹŻŽ"
_LOW = "a-zß-öø-ÿāăąćčďđēėęěğģīįıłńňőřśşšţťūůűźżž"
_PART = rf"[{_UP}][{_LOW}]+(?:[’'][{_UP}{_LOW}]+)?"
_CAPS = rf"[{_UP}]{{3,}}"
_WORD = rf"(?:{_PART}|{_CAPS})(?:-(?:{_PART}|{_CAPS}))*"
_SP = r"[ \u00a0\u202f]"

_CAPITAL = re.compile(rf"(?<![\w.@/`+-])(?:(?P<initial>[{_UP}]\.(?:-?[{_UP}]\.)?)(?![{_LOW}])|{_WORD}(?![\w@/`(]|\.\w|-\w))")
# Particles between a given name and a surname.
_GAP = re.compile(rf"{_SP}(?:(?:van|von|de|da|di|del|bin|ibn|ten|ter)(?:{_SP}(?:der|den|la))?{_SP})?")

# Titles and labels of trailers that state a person.
TITLE = re.compile(r"(?:\b(?:Dr|Ms|Mr|Mrs|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Dott|Dra)\.?[ \u00a0]|\bProfessor[ \u00a0]|\b(?:Signed-off-by|Co-authored-by|Reviewed-by|Author|Name): )$")
_MAILBOX = re.compile(r"[ \u00a0]<[^<>\n]{0,60}?(?:@|[ (\[{]at[ )\]}])[^<>\n]{1,60}>", re.I)

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+@-]){_LOCAL}(?:@|[ ]?(?:\(at\)|\[at\]|\{{at\}}|<at>)[ ]?|[ ](?:AT|at)[ ](?=[\w-]+[ ]?(?:\.|[ ]DOT[ ]|[ ]dot[ ]|\(dot\)|\[dot\]|DOT|dot)))"
    rf"{_HOST}(?:(?:\.|[ ]?(?:\(dot\)|\[dot\]|\{{dot\}})[ ]?|[ ](?:DOT|dot)[ ]){_HOST})*"
    rf"(?:\.|[ ]?(?:\(dot\)|\[dot\]|\{{dot\}})[ ]?|[ ](?:DOT|dot)[ ])[A-Za-z]{{2,}}(?![\w@-])",
    re.I,
)

_NUMBER = re.compile(
    r"(?<![\w.:,/#@+$*^=-])(?<!\d )"
    r"(?:\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d(?:[ .-]?\d){6,13}"
    r"|\(\d{2,4}\)[ ]?\d{3,5}[ .-]?\d{3,5}"
    r"|[A-Z]{2}(?:[ ]\d{2}){3}[ ][A-Z](?!\w)"
    r"|[A-Z]{1,2}(?:[ -]\d{2,4}){2,4}"
    r"|[A-Z]-\d{2}/\d{3,6}"
    r"|[A-Z]{1,2}\d{6,9}[A-Z]?"
    r"|\d{1,6}(?:[ .-]\d{2,6}){1,5}"
    r"|\d{6,20}[A-Z]?)"
    r"(?![\w/]|[.,:-]\d|[ ]?(?:ms|%|declarations|cases)\b)"
)

# Label words in front of numbers.
PHONE_BEFORE = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|sms|whatsapp|telefon|handy|téléphone|portable|teléfono|móvil|телефон|тел)\.?:?\s*(?:no\.?|number)?:?\s*|电话[：:]?\s*)$", re.I)
ID_BEFORE = re.compile(
    r"(?:\b(?:student|candidate|passport|matriculation|identity|national id(?:entity)?|identification|tax|taxpayer|social security|insurance|nino|ssn|nie|dni|nif|tin|ausweis\w*|matrikel\w*|steuer\w*|reisepass\w*|"
    r"passeport|étudiant|identité|fiscal\w*|pasaporte|matrícula|паспорт\w*|инн|снилс|студенч\w*)\b[\s.:-]*(?:card|id|identity|number|no|nr|num|numéro|número|номер|#|№|билет\w*)?\s*(?:number|no|nr|is|:)?[\s.:#]*|"
    r"学号[：:]?\s*|身份证号?[：:]?\s*|护照号?[：:]?\s*)$",
    re.I,
)

_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Row|Avenue|Ave\.?|Drive|Court|Place|Square|Terrace|Close|Way|Crescent|Hill|Gate|Walk|Mews|Boulevard|Blvd\.?)"
_TOWN = rf"(?:{_PART})(?:-{_PART})*(?:{_SP}(?:{_PART})(?:-{_PART})*)?"
_BREAK = r"(?:,?[ ]*\n[ \t]*(?:(?:--|>|-|#|//)[ ]?)?|,[ ]+)"
_CODE = r"(?:\d{5}|\d{2}-\d{3}|\d{4})"
ADDRESS = re.compile(
    rf"(?<![\w.:/-])(?:"
    rf"\d{{1,5}}[A-Za-z]?(?:[ ](?:{_PART})(?:[’']s?)?){{1,4}}?[ ]{_STREET_EN}{_BREAK}(?P<t1>{_TOWN})(?:[ ](?P<c1>{_CODE})(?![\w-]))?"
    rf"|\d{{1,5}}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|quai|impasse|allée)[ ](?:(?:de|du|des|la|le|les|l[’'])[ ]?)*(?:{_PART})(?:[ -](?:{_PART}))*{_BREAK}(?P<c2>{_CODE})[ ](?P<t2>{_TOWN})"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua)(?:[ ](?:de|del|de la|della|do|da))?(?:[ ](?:{_PART})){{1,4}},?[ ]\d{{1,5}}[a-z]?{_BREAK}(?P<c3>{_CODE})[ ](?P<t3>{_TOWN})"
    rf"|(?:[{_UP}][{_LOW}]+(?:weg|straße|strasse|pfad|gasse|allee|platz|ring|damm|ufer|str\.)|(?:Am|Im|An der|Zum|Zur)(?:[ ]{_PART}){{1,3}})[ ]\d{{1,5}}[a-z]?{_BREAK}(?P<c4>{_CODE})[ ](?P<t4>{_TOWN})"
    rf"|(?:ul|al|pl|os)\.[ ](?:{_PART})(?:[ ](?:{_PART}))*[ ]\d{{1,5}}[a-z]?(?:/\d{{1,4}})?{_BREAK}(?P<c5>{_CODE})[ ](?P<t5>{_TOWN})"
    rf")"
)
_TICKS = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]")
_ANY_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")


def bare(text: str) -> str:
    """The text with code quotations blanked; of the same length, so positions hold."""
    return _TICKS.sub(lambda m: "`" + "\x00" * (len(m.group(0)) - 2) + "`" if len(m.group(0)) > 2 else m.group(0), text)


def words(text: str) -> list[str]:
    """All words of a bare text, lower case."""
    return _ANY_WORD.findall(text.lower())


def _shape(s: str) -> str:
    return re.sub(r"\d", "9", re.sub(r"[A-Za-z]", "A", s))


def _number_free(token: str) -> str:
    return "0" if token.isdigit() else token


def _contexts(text: str, start: int, end: int) -> list[str]:
    left = [_number_free(t) for t in _TOKEN.findall(text[max(0, start - 30) : start].lower())[-2:]] or ["^"]
    right = [_number_free(t) for t in _TOKEN.findall(text[end : end + 30].lower())[:2]] or ["$"]
    return [left[-1], " ".join(left), right[0], " ".join(right)]


def _names(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, parts) of every reading of neighbouring capitalised words as a name; readings overlap."""
    found = list(_CAPITAL.finditer(text))
    part = [None if m.group("initial") else m.group(0).lower() for m in found]
    n = len(found)

    def near(i: int) -> bool:
        return i + 1 < n and found[i + 1].start() - found[i].end() < 12 and _GAP.fullmatch(text, found[i].end(), found[i + 1].start()) is not None

    for i in range(n):
        start, first = found[i].start(), part[i]
        if near(i):
            if part[i + 1] is not None:
                yield start, found[i + 1].end(), [p for p in (first, part[i + 1]) if p]
            if near(i + 1) and part[i + 2] is not None and (first is not None or part[i + 1] is None):
                # a second given name, in full or as an initial
                yield start, found[i + 2].end(), [p for p in part[i : i + 3] if p]
        if first is not None and i + 1 < n and text[found[i].end() : found[i + 1].start()] in (", ", ",\u00a0", ",\u202f"):
            yield start, found[i + 1].end(), [p for p in (first, part[i + 1]) if p]
            if part[i + 1] is not None and near(i + 1) and part[i + 2] is None:
                yield start, found[i + 2].end(), [first, part[i + 1]]


_AT = ("(at)", "[at]", "{at}", "<at>")
_HOST_AHEAD = re.compile(r"[\w-]+ ?(?:\.| dot |\(dot\)|\[dot\]|dot)")


def _may_hold_email(text: str) -> bool:
    """False only where EMAIL matches nowhere."""
    at = text.find("@")
    while at >= 0:
        if text[at - 1 : at].isalnum() and text[at + 1 : at + 2].isalnum():
            return True
        at = text.find("@", at + 1)
    low = text.lower()
    if any(form in low for form in _AT):
        return True
    at = low.find(" at ")
    while at >= 0:
        if _HOST_AHEAD.match(low, at + 4):
            return True
        at = low.find(" at ", at + 1)
    return False


def candidates(text: str) -> list[Candidate]:
    """All candidates of a bare text, in no particular order; they may overlap."""
    out: list[Candidate] = []
    if _may_hold_email(text):
        at = 0
        while m := EMAIL.search(text, at):
            s = m.group(0)
            # the host of a written-out reading may begin another
            blank = s.find(" ")
            at = m.end() if blank < 0 else m.start() + blank + 1
            written = "@" not in s and not re.search(r"[(\[{<]", s)
            host = re.split(r"@|[ ]?[(\[{<]at[)\]}>][ ]?|[ ]at[ ]", s.lower(), maxsplit=1)[1]
            host = re.sub(r"[ ]?[(\[{]dot[)\]}][ ]?|[ ]dot[ ]", ".", host)
            out.append(Candidate("email", m.start(), m.end(), "" if written else "email", [host, "." + host.rsplit(".", 1)[-1]], _contexts(text, m.start(), m.end())))
    taken = bytearray(len(text))
    for c in out:
        if c.seed:
            taken[c.start : c.end] = b"\x01" * (c.end - c.start)
    for m in ADDRESS.finditer(text):
        form = next(t for t in ("1", "2", "3", "4", "5") if m.group("t" + t))
        town = re.split(_SP, m.group("t" + form))
        coded, end = m.group("c" + form) is not None, m.end()
        behind = form == "1" and coded
        # a second capitalised word may be the town's or open the next sentence: the corpus decides
        closed = "coded" if behind else "sure" if re.match(r"[.,;)\n]|[ \u00a0]?。|\s*$", text[end : end + 3]) or len(town) == 1 else "open"
        short = end - len(town[-1]) - 1 if len(town) == 2 and not behind else end
        second = town[1].lower() if len(town) == 2 else None
        out.append(Candidate("address", m.start(), end, "address" if coded else "", [town[0].lower(), "form " + form], _contexts(text, m.start(), end), closed, second, short))
        taken[m.start() : end] = b"\x01" * (end - m.start())
    for m in _NUMBER.finditer(text):
        s = m.group(0)
        digits = sum(c.isdigit() for c in s)
        if digits < (6 if s[0].isalpha() else 7) or taken[m.start()]:
            continue
        if re.match(r"\d{4}-\d{2}-\d{2}", s) or re.fullmatch(r"\d+-\d+", s) and digits < 9:
            continue
        left = text[max(0, m.start() - 48) : m.start()]
        seed = "id_number" if ID_BEFORE.search(left) else "phone" if PHONE_BEFORE.search(left) or s[0] == "+" else ""
        out.append(Candidate("number", m.start(), m.end(), seed, [_shape(s)], _contexts(text, m.start(), m.end())))
    readings = [r for r in _names(text) if not any(taken[r[0] : r[1]])]
    # a title or mailbox states the shortest reading beside it; the corpus decides on longer ones
    opens: dict[int, int] = {}
    closes: dict[int, int] = {}
    for start, end, _ in readings:
        opens[start] = min(end, opens.get(start, end))
        closes[end] = max(start, closes.get(end, start))
    titled = {s for s in opens if TITLE.search(text[max(0, s - 24) : s])}
    boxed = {e for e in closes if _MAILBOX.match(text, e)}
    for start, end, parts in readings:
        stated = start in titled and opens[start] == end or end in boxed and closes[end] == start
        out.append(Candidate("name", start, end, "name" if stated else "", parts, _contexts(text, start, end)))
    return out
