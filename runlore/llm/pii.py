"""Problem 10: personal information in free text, found and replaced by typed placeholders."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.llm.bpe import VOCABULARY, vocabulary_path

#: The kinds that are looked for by their form; dates of birth come along where they are named as such.
KINDS = ("email", "phone", "id_number", "address", "name")

_S = r"[\s\u200b\u200c\u2060\ufeff]"
#: White space within a line.
_B = r"[^\S\n\r\v\f\u2028\u2029]"
_UP = "A-ZÀ-ÖØ-ÞŁŚŠŹŻŽČĆĐŘŐŰĞİŞ"
_CAP = rf"[{_UP}][^\W\d_]*(?:[’'][^\W\d_]+)?"
_LAST = rf"{_CAP}(?:-{_CAP})?"
_INIT = rf"[{_UP}]\."
#: Given and family name, family name and given name, or initials and family name.
_PERSON = rf"(?:{_LAST}(?:{_B}{{1,2}}{_INIT})?{_B}{{1,2}}{_LAST}|{_LAST},{_B}{_LAST}(?:{_B}{_INIT})?|{_INIT}(?:{_B}?{_INIT})?{_B}?{_LAST})"

# -- e-mail
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])")
_SPELT = re.compile(
    rf"(?<![\w.+\-])[\w.+\-]*\w{_S}?(?:(?:\(at\)|\[at\]|\{{at\}}|<at>){_S}?[\w\-]+(?:{_S}?(?:\(dot\)|\[dot\]|\{{dot\}}|<dot>|\.){_S}?[A-Za-z][\w\-]*)+"
    rf"|{_S}at{_S}[\w\-]+(?:{_S}dot{_S}[A-Za-z][\w\-]*)+)",
    re.I,
)
_LOGIN = re.compile(rf"(?:\b(?:ssh|scp|sftp|rsync|mosh|ssh-copy-id|git{_S}+clone|clone{_S}+it{_S}+from){_S}[^\n`]*|://\S*)\Z", re.I)
_UNITS = ("service", "socket", "timer", "target", "mount", "slice", "scope")

# -- phone
_EXT = rf"(?:{_B}?(?:ext\.?|x|Durchwahl){_B}?\d{{1,5}})?"
_SEP = r"[ \u00a0.\-/\t]"
_PHONE = re.compile(
    rf"(?<![\w+.\-/])(?:"
    rf"\+\d{{1,3}}(?:{_SEP}?\(?\d{{1,5}}\)?){{2,6}}"
    rf"|00{_SEP}?\d{{1,3}}(?:{_SEP}\(?\d{{2,5}}\)?){{2,5}}"
    rf"|(?:1{_SEP})?(?:\(\d{{3}}\){_SEP}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}"
    rf"|0[1-9](?:{_SEP}\d{{2}}){{4}}"
    rf"|\(?0\d{{2,4}}\)?{_SEP}\d{{3,5}}{_SEP}\d{{2,4}}"
    rf"){_EXT}(?![\w]|[.\-/]\w)",
    re.I,
)
_CALLED = re.compile(
    rf"\b(?:call|phone|tel(?:[ée]fono)?|telefon|t[ée]l[ée]phone|mobile|mobil|handy|fax|sms{_S}sent{_S}to|ring|oncall_phone|rufnummer)\b\.?[^\w\n+(]{{0,4}}(?P<v>\+?[\d(][\d \t\u00a0().\-/]{{5,17}}\d){_EXT}(?![\d])", re.I
)

# -- identity numbers
_LABEL = (
    rf"(?:\bSSN|\bsocial{_S}security|\bNI\b|\bNINO|\bnational{_S}insurance|\binsurance|\bnational{_S}ID|\bidentity(?:{_S}card)?|\bID{_S}(?:card|number)|\btax(?:payer)?{_S}(?:ID|number|no\.?)|\bTIN\b|\bITIN\b|\bEIN\b"
    rf"|\bSteuer-?(?:ID|nummer|identifikationsnummer)|\bpass(?:port|eport|aporte)|\bReisepass|\bPersonalausweis|\bSozialversicherungsnummer|\bNIF\b|\bDNI\b|\bNIE\b|\bCPF\b|\bBSN\b|\bPESEL\b|\bAHV\b|\bpersonnummer"
    rf"|\bs[ée]curit[ée]{_S}sociale|\bseguridad{_S}social)"
)
_LABELLED = re.compile(
    rf"{_LABEL}(?:{_S}(?:number|no\.?|nr\.?|num\.?|ID|code|#))?{_S}?[:=#]?{_S}?(?P<v>(?:[A-Z]{{1,2}}{_SEP}?)?\d(?:{_SEP}?\d){{5,13}}(?:{_SEP}?[A-Z]\b)?)(?![\w]|-\w)", re.I
)
_BARE_ID = re.compile(
    rf"(?<![\w.\-/+])(?:\d{{3}}-\d{{2}}-\d{{4}}|[A-Z]{{2}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}{_SEP}?[A-D]|[A-Z]{{2}}\d{{7}}|\d{{8}}-\d{{4}}|00(?:{_SEP}\d{{3}}){{3}})(?![\w]|[.\-/]\w)"
)

# -- street addresses
_NOT_STREET = r"(?!(?:on|in|of|at|the|a|an|and|to|for|by|is|are|was|days?|disks?|hours?|minutes?|seconds?|nodes?|hosts?|files?|times?|more|de|des|du|la|le|les|von|der|die|das)\b)"
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Boulevard|Blvd|Drive|Dr|Way|Place|Pl|Square|Sq|Terrace|Ter|Close|Row|Crescent|Cres|Parkway|Pkwy|Highway|Hwy|Mews|Quay|Walk|Gardens|Grove|Hill)\b\.?"
_FLAT = rf"(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?{_S}#?\w{{1,5}}"
_TOWN = rf"(?:[{_UP}][\w’'\-]+(?:{_S}[{_UP}][\w’'\-]+)?)"
_EN = (
    rf"(?:{_FLAT},?{_S})?(?<![\w.:\-/])\d{{1,5}}[A-Za-z]?{_S}(?:{_NOT_STREET}[A-Za-z][\w’'\-]*{_S}){{1,3}}{_STREET}"
    rf"(?:,{_S}{_FLAT})?(?:(?:,{_S}|\n){_TOWN}(?:,{_S}[A-Z]{{2}}{_S}\d{{5}}|{_S}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}})?)?"
)
_ZIP = rf"(?:,?{_S}\d{{4,5}}{_S}{_TOWN})?"
_DE = rf"\b[{_UP}][\w\-]*(?:stra(?:ß|ss)e|str\.|allee|weg|gasse|platz|ring|damm|ufer|STRASSE|ALLEE|WEG|GASSE|PLATZ|RING|DAMM|UFER){_S}\d{{1,4}}[a-z]?\b{_ZIP}"
_FR = rf"(?<![\w.:\-/])\d{{1,4}}(?:{_S}?(?:bis|ter))?,?{_S}(?:rue|avenue|boulevard|bd|impasse|chemin|all[ée]e|place|quai|cours|route|square|passage|RUE|AVENUE|BOULEVARD|IMPASSE|CHEMIN|PLACE|QUAI){_S}(?:(?:de{_S}la|de{_S}l[’']|du|des|de|d[’']|la|le|les|DE{_S}LA|DU|DES|DE){_S}?)?[{_UP}][\w’'\-]+(?:{_S}[{_UP}][\w’'\-]+)?{_ZIP}"
_ES = rf"\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|CALLE|AVENIDA|PLAZA|PASEO){_S}(?:(?:de{_S}(?:la|los|las)|del|de|DE{_S}LA|DEL|DE){_S})?[{_UP}][\w’'\-]+(?:{_S}[{_UP}][\w’'\-]+)?,?{_S}\d{{1,4}}\b{_ZIP}"
_ADDRESS = {k: re.compile(p) for k, p in (("en", _EN), ("de", _DE), ("fr", _FR), ("es", _ES))}
#: Cheap signs without which an address pattern cannot match, and how far around the sign it can reach.
_STREET_END = re.compile(rf"(?:{_STREET[3:_STREET.index(')')]})\b")
_HOUSE_END = re.compile(rf"(?:stra(?:ß|ss)e|str\.|allee|weg|gasse|platz|ring|damm|ufer|STRASSE|ALLEE|WEG|GASSE|PLATZ|RING|DAMM|UFER){_S}\d")
_FR_SIGNS = ("rue", "avenue", "boulevard", "bd", "impasse", "chemin", "allée", "allee", "place", "quai", "cours", "route", "square", "passage")
_FR_SIGN = re.compile(rf"\d,?{_S}?(?:bis|ter)?,?{_S}(?:{'|'.join(_FR_SIGNS)})", re.I)
_ES_SIGNS = ("calle", "avenida", "avda", "plaza", "paseo", "camino", "carrera")
#: Six digits or more, hardly apart: where a telephone or identity number can be.
_ZONE = re.compile(r"\d(?:[ \u00a0\t.()/\-]{0,3}\d){5,}")
_REACH = 60

# -- names
#: What stands right before a name, in lower case and single blanks: it announces a person by itself.
_CUES = (
    "ask", "thanks to", "thanks", "thank", "merci à", "merci a", "gracias a", "danke an", "rückfragen bitte an", "ruckfragen bitte an", "preguntas a", "signed", "signed by", "signed-off-by:", "reviewed-by:", "co-authored-by:",
    "acked-by:", "tested-by:", "reported-by:", "reviewed by", "written by", "approved by", "reported by", "maintained by", "owned by", "prepared by", "edited by", "merged by", "assigned to", "on call:", "on call this week:",
    "owner =", "owner=", "owner:", "owner :", "author =", "author=", "author:", "author :", "maintainer =", "maintainer=", "maintainer:", "contact:", "kontakt:", "assignee =", "assignee=", "assignee:", "name =", "name=", "name:",
    "dear", "mr.", "mrs.", "ms.", "dr.", "mr", "mrs", "ms", "dr", "herr", "frau", "señor", "señora", "madame", "monsieur", "my name is", "regards,", "cheers,", "sincerely,",
)
#: What may stand before a person and before much else: a name after it must have the form of one.
_HINTS = frozenset(
    """with to by from and or for told tell asked met meet meeting cc contact call called email emailed mail ping pinged engineer engineers colleague colleagues manager lead developer admin administrator operator customer
    client user teammate intern analyst director doctor professor nurse teacher contractor candidate employee president author reviewer sir neighbour neighbor mit von und avec et por con y de""".split()
)
#: What a person then does; ``_MAYBE`` after a name that has the form of one.
_AFTER = re.compile(rf"{_S}(?:said|says|found{_S}(?:that|out)|wrote|writes|asked|reported|noticed|approved|confirmed|joined|mentioned|replied|answered|suggested|agreed|pointed{_S}out|fixed|merged)\b", re.I)
_MAYBE = re.compile(rf"{_S}(?:joins|thinks|wants|lives|knows|told|called|sent|and{_S}I)\b", re.I)
_ANY = re.compile(rf"(?<![\w.@/\-])(?P<v>{_PERSON})(?![\w@])")
_MORE = re.compile(rf"{_B}(?P<v>{_LAST})(?=[.,;!?)\n]|\Z)")
#: Characters that are looked back over for a cue: more than twice the longest, so that blanks may be drawn out.
_BACK = 48

#: Words that no family or given name is, in the places where names are looked for: those of the grammar and the calendar.
_NO_NAME = frozenset(
    """the a an and or of on in to for from at by it its this that these our we you they he she who what when where why how nobody somebody anybody anyone everyone
    is are was were be been has have had will would can could may must should not no yes all any each every some both before after if then than but so
    monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
    der die das den dem le la les el los las un una une ein eine""".split()
)
#: Words that make a pair of capitals a group, a thing or a place.
_GROUPS = frozenset("team teams group service services platform squad department office desk support system project cluster server street road avenue lane court window period release version".split())


@lru_cache(4)
def common_words(path: str) -> frozenset[str]:
    """Words that a public vocabulary has whole and in lower case: the everyday words of its language. A capitalised
    word that is none of them is more likely a name."""
    out = set()
    for line in Path(path).read_bytes().splitlines():
        token = base64.b64decode(line.split()[0]) if line else b""
        if len(token) > 2 and token[:1] == b" " and token[1:].isalpha() and token.islower():
            out.add(token[1:].decode("ascii"))
    return frozenset(out)


class Feistel:
    """Keyed permutations of digit and letter strings that keep their length and alphabet.

    Ten rounds over two halves, as in format-preserving encryption; the round function is keyed BLAKE2. Each
    length and alphabet has a permutation of its own, so equal values stay equal and different ones differ.
    """

    ROUNDS = 10

    def __init__(self, key: str) -> None:
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, i: int, radix: int, n: int, half: int) -> int:
        h = hashlib.blake2b(f"{i}|{radix}|{n}|{half}".encode(), key=self.key, digest_size=16)
        return int.from_bytes(h.digest(), "big")

    def permute(self, symbols: list[int], radix: int, back: bool = False) -> list[int]:
        n = len(symbols)
        if n == 0:
            return []
        if n == 1:  # a rotation is the whole of a one-place permutation
            r = self._round(0, radix, 1, 0)
            return [(symbols[0] + (-r if back else r)) % radix]
        u = n // 2
        sizes = (radix**u, radix ** (n - u))
        a = b = 0
        for x in symbols[:u]:
            a = a * radix + x
        for x in symbols[u:]:
            b = b * radix + x
        for i in range(self.ROUNDS - 1, -1, -1) if back else range(self.ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                a = (a + sign * self._round(i, radix, n, b)) % sizes[0]
            else:
                b = (b + sign * self._round(i, radix, n, a)) % sizes[1]
        out = []
        for value, places in ((b, n - u), (a, u)):
            for _ in range(places):
                value, r = divmod(value, radix)
                out.append(r)
        return out[::-1]

    def value(self, text: str, back: bool = False) -> str:
        """Digits permuted among digits and letters among capitals; other characters stay in place."""
        digits = [i for i, c in enumerate(text) if c.isdigit()]
        letters = [i for i, c in enumerate(text) if c.isascii() and c.isalpha()]
        out = list(text)
        for i, x in zip(digits, self.permute([int(text[i]) for i in digits], 10, back)):
            out[i] = str(x)
        for i, x in zip(letters, self.permute([ord(text[i].upper()) - 65 for i in letters], 26, back)):
            out[i] = chr(65 + x)
        return "".join(out)

    def tag(self, text: str) -> str:
        """A keyed tag of a value without a number format; 128 bits, so different values hardly ever share one."""
        return hashlib.blake2b(text.encode(), key=self.key, digest_size=16).hexdigest()

    def number(self, x: int, size: int) -> int:
        """A permutation of the numbers below ``size``: walked on until it falls within."""
        places = len(str(size - 1))
        while True:
            x = int("".join(map(str, self.permute([int(c) for c in f"{x:0{places}d}"], 10))))
            if x < size:
                return x

    def date(self, text: str) -> str:
        """A date permuted among the days of two centuries, written as it was."""
        day = date.fromordinal(_FIRST + self.number(_day(text) - _FIRST, _DAYS))
        if text[4:5] == "-":
            return day.isoformat()
        sep, (one, two, _) = next(c for c in text if not c.isdigit()), re.split("[./]", text)
        a, b = (day.day, day.month) if sep == "." or int(one) > 12 else (day.month, day.day)
        return f"{a:0{len(one)}d}{sep}{b:0{len(two)}d}{sep}{day.year}"


#: The days that dates of birth are permuted among: 1900 to 2099.
_FIRST, _DAYS = date(1900, 1, 1).toordinal(), 73_049


def _day(text: str) -> int | None:
    """The day number of a valid date."""
    try:
        if text[4:5] == "-":
            day = date.fromisoformat(text).toordinal()
        else:
            one, two, year = map(int, re.split("[./]", text))
            day = (date(year, two, one) if "." in text or one > 12 else date(year, one, two)).toordinal()
    except ValueError:
        return None
    return day if _FIRST <= day < _FIRST + _DAYS else None


def _tax_check(digits: str) -> str:
    """The last of eleven digits by ISO 7064 mod 11, 10."""
    x = 10
    for c in digits:
        x = ((int(c) + x) % 10 or 10) * 2 % 11
    return str((11 - x) % 10)


#: Numbers with a check digit or letter: form, and the check of what stands before it. Fixed values.
_CHECKED = ((re.compile(r"\d{11}"), _tax_check), (re.compile(r"\d{8}[A-Z]"), lambda v: "TRWAGMYFPDXBNJZSQVHLCKE"[int(v) % 23]))


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+%-")


def _mails(text: str, low: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        a, m = at, _HOST.match(text, at + 1)
        if m:
            while a and (text[a - 1] in _LOCAL or text[a - 1].isalnum()):
                a -= 1
            whole = a < at and (text[at - 1].isalnum() or text[at - 1] == "_") and not (a and text[a - 1] == "@")
            if whole and _is_mail(text, a, m):
                yield a, m.end()
        at = text.find("@", at + 1)
    if "dot" in low or any(x in low for x in ("(at)", "[at]", "{at}", "<at>")):
        for m in _SPELT.finditer(text):
            yield m.span()


def _is_mail(text: str, a: int, m: re.Match) -> bool:
    """Not a login on a machine, a clone address or a unit."""
    labels = m[0].lower().split(".")
    after = text[m.end() : m.end() + 2]
    if text[a : m.start() - 1].lower() == "git" or labels[-1] in _UNITS or labels[0][-1].isdigit() and len(labels) > 2:
        return False
    if after[:1] == ":" and after[1:] and (after[1:].isalnum() or after[1:] in "/~"):
        return False
    return not _LOGIN.search(text[max(0, a - 80) : a])


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    found: set[tuple[int, int, str]] = set()
    done = 0
    for zone in _ZONE.finditer(text):
        a, b = max(done, zone.start() - _REACH), min(len(text), zone.end() + 16)
        done = max(done, zone.start() - 4)
        for m in _LABELLED.finditer(text, a, b):
            if 6 <= _digits(m["v"]) <= 14:
                found.add((*m.span("v"), "id_number"))
        for m in _BARE_ID.finditer(text, a, b):
            found.add((*m.span(), "id_number"))
        for rx in (_PHONE, _CALLED):
            for m in rx.finditer(text, a, b):
                x, y = m.span("v") if rx is _CALLED else m.span()
                if 7 <= _digits(text[x:y]) <= 17:
                    found.add((x, y, "phone"))
    yield from found


def _addresses(text: str, low: str) -> Iterator[tuple[int, int, str]]:
    found: set[tuple[int, int]] = set()
    for kind, sign in (("en", _STREET_END), ("de", _HOUSE_END)):
        for hit in sign.finditer(text):
            found.update(m.span() for m in _ADDRESS[kind].finditer(text, max(0, hit.start() - _REACH - 20), hit.end() + _REACH + 20))
    if any(x in low for x in _FR_SIGNS):
        for hit in _FR_SIGN.finditer(text):
            found.update(m.span() for m in _ADDRESS["fr"].finditer(text, max(0, hit.start() - 8), hit.end() + _REACH + 40))
    if any(x in low for x in _ES_SIGNS):
        found.update(m.span() for m in _ADDRESS["es"].finditer(text))
    for a, b in found:
        yield a, b, "address"


_PART = re.compile(r"[^\W\d_]+")


def _before(text: str, at: int) -> str:
    return " ".join(text[max(0, at - _BACK) : at].lower().rstrip("\"'( \t\u00a0\n\r").split())


def _cued(before: str) -> bool:
    """Whether what stands before announces a person."""
    return before.endswith(_CUES) and any(before.endswith(c) and not before[: -len(c)][-1:].isalnum() for c in _CUES)


def _names(text: str, common: frozenset[str]) -> Iterator[tuple[int, int]]:
    """A pair of capitalised words, or initials and one, that a cue announces, that does what persons do, or that
    stands where a person may and has the form of a name: no everyday words."""
    at, end = 0, -1
    while m := _ANY.search(text, at):
        parts = [w for w in _PART.findall(m["v"]) if len(w) > 1]
        low = [w.lower() for w in parts]
        rare = [w not in common for w in low]
        before, odd = "", sum(w in _NO_NAME for w in low)
        ok = bool(parts) and any(len(w) > 2 for w in parts) and odd < len(parts)
        if ok:
            before = _before(text, m.start())
            ok = odd == 0 or before.endswith((":", "="))  # Will and May may sign
        if ok:
            ok = _cued(before) or bool(_AFTER.match(text, m.end()))
            if ok:  # a cue may also announce a group
                ok = not any(w in _GROUPS for w in low) and (any(rare) or before.endswith((":", ".", "=", "signed")))
            elif odd == 0 and all(rare) and len(parts) > 1 and not any(w.isupper() for w in parts):
                joined = end >= 0 and text[end : m.start()].strip().lower() in ("and", "&", ",", "und", "et", "y")
                ok = joined or before.rpartition(" ")[2] in _HINTS or bool(_MAYBE.match(text, m.end()))
        if not ok:  # the pair may begin with the word before a name
            at = m.start() + len(_PART.match(text, m.start())[0])
            continue
        a, end = m.span("v")
        while (more := _MORE.match(text, end)) and all(w.lower() not in common and w.lower() not in _NO_NAME for w in _PART.findall(more["v"])) and "," not in m["v"]:
            end = more.end()
        yield a, end
        at = end


# -- dates of birth
_BIRTH_SIGNS = ("born", "birth", "dob", "gebor", "geburt", "né", "nacimiento", "nacid")
_BORN = re.compile(
    rf"(?:\bborn(?:{_S}on)?|\bdate{_S}of{_S}birth|\bbirth{_S}?(?:date|day)|\bDOB|\bgeboren(?:{_S}am)?|\bGeburtsdatum|\bnée?{_S}le|\bfecha{_S}de{_S}nacimiento|\bnacid[oa]{_S}el){_S}?[:=]?{_S}?"
    r"(?P<v>(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})|(?P<d2>\d{1,2})(?P<sep>[./])(?P<m2>\d{1,2})(?P=sep)(?P<y2>\d{4}))(?![\w]|[.\-/]\w)",
    re.I,
)


def _birth_dates(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BORN.finditer(text):
        if _day(m["v"]) is not None:
            yield *m.span("v"), "birth_date"


def find_spans(text: str, common: frozenset[str]) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order; where two overlap the more certain kind stays.

    ``common`` are everyday words in lower case, as ``common_words`` takes them from a public vocabulary.
    """
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []

    def offer(spans: Iterator) -> None:
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
            i = bisect.bisect_left(starts, b)  # the last span that begins before this one ends
            if i == 0 or out[i - 1][1] <= a:
                starts.insert(i, a)
                out.insert(i, (a, b, kind))

    low = text.lower()
    offer((a, b, "email") for a, b in _mails(text, low))
    if any(x in low for x in _BIRTH_SIGNS):
        offer(_birth_dates(text))
    offer(_numbers(text))
    offer(_addresses(text, low))
    offer((a, b, "name") for a, b in _names(text, common))
    return out


def canonical(value: str, kind: str) -> str:
    """What equal values of a kind share, whatever their spelling."""
    if kind in ("phone", "id_number"):
        if kind == "phone":
            value = re.split(r"(?i)ext|x|Durchwahl", value)[0]
        v = re.sub(r"[^0-9A-Za-z]", "", value).upper()
        if kind == "phone":
            v = v[2:] if v.startswith("00") else v
            v = v[1:] if len(v) == 11 and v[0] == "1" else v
        return v
    if kind == "email":
        v = re.sub(rf"{_S}*[(\[{{<]?\b(at|dot)\b[)\]}}>]?{_S}*", lambda m: "@" if m[1].lower() == "at" else ".", value.lower()) if "@" not in value else value.lower()
        return re.sub(r"\s", "", v)
    if kind == "name" and "," in value:
        last, _, first = value.partition(",")
        value = f"{first.strip()} {last}"
    return " ".join(re.findall(r"\w+", value.casefold()))


def alias(value: str, kind: str, feistel: Feistel) -> str:
    """What stands for a value: digits and letters permuted in place, so separators stay as they were written; equal
    numbers in different spellings have the same ones. A number whose check digit is right keeps a right one."""
    if kind == "birth_date":
        return feistel.date(value)
    v = canonical(value, kind)
    if kind not in ("phone", "id_number"):
        return feistel.tag(v)
    for form, check in _CHECKED:
        if kind == "id_number" and form.fullmatch(v) and check(v[:-1]) == v[-1]:
            new = feistel.value(v[:-1])
            new += check(new)
            break
    else:
        new = feistel.value(v)
    at = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    if kind == "phone":  # an extension and the prefix that only dials out stay
        n = len(re.split(r"(?i)ext|x|Durchwahl", value)[0])
        at = [i for i in at if i < n][-len(v) :]
    out = list(value)
    for i, c in zip(at, new):
        out[i] = c
    return "".join(out)


def replace_spans(text: str, spans: list[tuple[int, int, str]], feistel: Feistel) -> str:
    """Each span replaced by [KIND:pseudonym]; everything else is left as it is."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}:{alias(text[a:b], kind, feistel)}]"]
        at = b
    return "".join([*out, text[at:]])


def pseudonymise(df: DataFrame, id_col: str, text_col: str, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows with personal information: id, clean (text with placeholders), kinds array<string>, n_spans.

    One narrow pass over whole texts. Numbers and dates of birth are permuted within their format under ``key`` (a
    secret of the caller's: who knows it can undo the permutation), so equal values have equal pseudonyms in all
    documents; mails, names and addresses get a keyed tag. ``vocabulary`` is the public one whose everyday words tell
    names from other capitals. Null and empty texts hold nothing; other columns and repeated ids do not matter.
    """
    if not key:
        raise ValueError("a secret key is needed")
    path = vocabulary_path(vocabulary)
    picked = df.where(F.col(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel, common = Feistel(key), common_words(path)
        for b in batches:
            keep, clean, kinds, counts = [], [], [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                spans = find_spans(text, common)
                if spans:
                    keep.append(i)
                    clean.append(replace_spans(text, spans, feistel))
                    kinds.append(sorted({k for _, _, k in spans}))
                    counts.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.int64())], names=["id", "clean", "kinds", "n_spans"]
            )

    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, clean string, kinds array<string>, n_spans long")
    return out.withColumnRenamed("id", id_col)
