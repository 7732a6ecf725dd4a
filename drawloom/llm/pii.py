"""Personal information in free text: places with their types, typed placeholders, and keyed surrogates.

``find_places`` reads a whole text once per type and gives non-overlapping places (start and end in code points). E-mail
addresses, phone numbers, identity numbers and street addresses are told by their form and by the label before them; names of
persons by a lexicon of name parts, generalised: family names that share a beginning and an ending with known ones count as
known, and a capitalised word before a family name as a given name.

``surrogates`` replaces each entity by another one of its type: keyed by a secret, so that an entity has the same replacement in
all documents (coreference; within a document "J. Smith" is the one full name there that it fits), of the same form (digits for
digits, letters for letters of the same script, case and separators kept; names by names of the same language and gender, as far
as the lexicon, the titles before a given name in all documents, or else its ending tell). Two entities never share a replacement,
and no replacement is an entity of the corpus: candidates are drawn again, keyed by entity and round, until an anti-join with both
the corpus' entities and what was given already leaves none. Later rounds draw from larger spaces (double family names, recoded
names, longer texts), so that this ends.

Defined results: null texts have no places and stay null; empty texts stay empty. Texts are read whole, of any length, in time
linear in it. Repeated rows give repeated places.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re
import unicodedata
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.operators.references import heavy_keys, split_join
from drawloom.storage import spread, written

KINDS = ("email", "id_number", "phone", "address", "name")

# ---- forms -----------------------------------------------------------------------------------------------------------

_DOT = r"(?:\.| dot | ?\[dot\] ?| ?\(dot\) ?)"
#: A local part has at most ten parts, a domain at most ten labels.
_LOCAL = r"(?<![\w.+%-])[\w+%-]+(?:(?:\.| dot |\[dot\]| \[dot\] |\(dot\))[\w+%-]+){0,9}"
_EMAIL = [
    re.compile(rf"{_LOCAL}(?: ?[@＠] ?| ?\(at\) ?| ?\[at\] ?)[^\W_](?:[\w-]*{_DOT}){{1,10}}[^\W\d_]{{2,}}(?![\w-])"),
    re.compile(rf"{_LOCAL} at (?:[\w-]+ dot ){{1,10}}[^\W\d_]{{2,}}(?![\w-])", re.I),
]
_EMAIL_HINT = [re.compile(r"[@＠](?=[\w ])|[(\[]at[)\]](?=[\w ])"), re.compile(r" at (?=[\w-]+ dot )", re.I)]
#: Signs that no local part has.
_NOT_LOCAL = "\n,:;<>=/\"'@＠"

_S = r"[-.    ‐‑‒–]"
_NOT_BEFORE = r"(?<![\w+])(?<!\w[-./])"
_NOT_AFTER = r"(?![-./‐‑]?\d)(?![^\W\d_])"
_EXT = r"(?:,? ?(?:ext\.?|extension|x|poste|Durchwahl|int\.?) ?\d{1,6})?"
_PHONE = [
    # with a country code; the number of digits is looked at afterwards
    re.compile(rf"(?<![\w+])(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|(?<![\d.,/-])00\d{{2,3}}(?=[ -]))(?:{_S}?\(\d{{1,4}}\){_S}?|{_S}?\d{{1,12}})(?:[-. / ‐‑]?\d{{2,10}}){{0,5}}{_EXT}{_NOT_AFTER}", re.I),
    # North America
    re.compile(rf"{_NOT_BEFORE}(?:1{_S})?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}{_EXT}{_NOT_AFTER}", re.I),
    # national forms with a leading zero
    re.compile(rf"{_NOT_BEFORE}(?:0\d(?:{_S}\d{{2}}){{4}}|\(?0\d{{2}}\)?{_S}\d{{4}}{_S}\d{{4}}|\(?0\d{{4}}\)?{_S}\d{{6}}|\(?0\d{{2,4}}\)?[- / ]\d{{4,6}}[-  ]?\d{{2,4}}){_EXT}{_NOT_AFTER}", re.I),
]
_PHONE_LABEL = r"(?:tel(?:efon|éfono|éphone|ephone)?|cell|mobile|m[óo]vil|phone|handy|call|text|caller|fax|ring|dial|ph)"
_PHONE_LABEL_END = re.compile(rf"\b{_PHONE_LABEL}(?:[.:=]|\"?: ?\")? ?$", re.I)
_PHONE_LABELLED = re.compile(rf"\d(?:\d{{2}}{_S}\d{{4}}|\d{{9,10}}|\d{{2}}{_S}\d{{3}}{_S}\d{{3}}){_EXT}{_NOT_AFTER}", re.I)

_NO_ID = re.compile(r"(?:chunks?|tickets?|jobs?|draws?|builds?|tags?|versions?|seeds?|serial|steps?|batch|trials?|runs?|tag|order|part|commit|issue|range)[ #:.]*$", re.I)
_ID_LABEL = r"(?:SSN|soc(?:ial)?\.? sec(?:urity)?(?: no\.?| number| #| nr\.?)?|id(?: no\.?| number| card)?|INSEE|NIR|num[ée]ro de s[ée]cu(?:rit[ée] sociale)?|n[ºo°]? ?de s[ée]cu|sozialversicherung\w*|seguridad social)"
_ID = [
    re.compile(r"\d(?<![\w.-]\d)\d{2}[-‐‑]\d{2}[-‐‑]\d{4}(?![-.]?\d|\w)"),
    re.compile(r"\d(?<![\w.-]\d)\d\.\d{3}\.\d{3}[- ]?[A-Z](?!\w)"),
    re.compile(r"\d(?<![\w.-]\d)\d{7}-?[A-Z](?![\w-])"),
    re.compile(r"[XYZ](?<![\w.-].)-?\d{7}-?[A-Z](?!\w)"),
    re.compile(r"(?<![\w.-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]([ -]?)\d{2}\1\d{2}\1\d{2}\1[A-D](?!\w)|(?<![\w.-])QQ([ -]?)\d{2}\2\d{2}\2\d{2}\2[A-D](?!\w)"),
    re.compile(r"[1-478](?<![\w.-].) \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?(?! ?\d|\w)"),
    re.compile(r"[1-478](?<![\w.-].)\d{2}(?:0[1-9]|1[0-2]|99)\d{8}(?:\d{2})?(?!\w)"),
]
_ID_LABEL_END = re.compile(rf"\b{_ID_LABEL}[ :#.º°]*\s?$", re.I)
_ID_LABELLED = re.compile(r"\d(?:\d{2}[- ]?\d{2}[- ]?\d{4}|(?<=[1-478])(?:[ .]?\d{2}){3}(?:[ .]?\d{3}){2}(?:[ .]?\d{2})?)(?![-.]?\d|\w)")
_PASSPORT_END = re.compile(r"\b(?:pass(?:port|eport)?|reisepass|pasaporte|passnummer)(?: (?:no|nr|n)\.?| ?n[º°]| number| #)?[ :.#]*\s?$", re.I)
_PASSPORT = re.compile(r"[A-Z](?<!\w.)(?:[A-Z0-9]\d[A-Z0-9]?\d{5,6}|[A-Z]?\d{6,8}|\d[A-Z]\d{6})(?!\w)|\d(?<!\w\d)\d{8}(?!\w)")


#: Six digits or more, never more than three other signs apart: every id number and phone (but for its extension) lies within one such stretch and a few signs around it.
_DIGITS = re.compile(r"\d(?:\D{0,3}\d){5,}")
_BEFORE, _BEHIND = 6, 40

#: Any id number or phone; a stretch without one is not looked at further. The form with references to its own groups comes first.
_ANY_NUMBER = re.compile("|".join([_ID[4].pattern, *(f"(?:{r.pattern})" for r in (*_ID[:4], *_ID[5:], _PASSPORT, _ID_LABELLED)), *(f"(?i:{r.pattern})" for r in (*_PHONE, _PHONE_LABELLED))]))

_HOUSE = r"\d(?<![\w.,:/#-]\d)\d{0,3}[a-zA-Z]?"
_STREET_FULL = r"(?:street|road|lane|drive|avenue|close|terrace|court|way|place|square|crescent|boulevard|gardens|grove|mews|parade)"
_STREET_ABBR = r"(?:st|rd|ln|dr|ave|ct|pl|sq|cres|blvd)"
_UNIT = r"(?:,? (?:apartment|apt|flat|unit|suite|ste|floor|fl|room|rm|no)\.? ?\d{1,4}[a-zA-Z]?(?!\w)|,? #\d{1,4}[a-zA-Z]?(?!\w)|,? \d{1,2}(?:st|nd|rd|th) floor)?"
_NAMEWORD = r"[^\W\d_][\w'’-]*"
_ADDRESS_EN = re.compile(rf"{_HOUSE},? ((?:{_NAMEWORD} ){{1,4}}?)(?:{_STREET_FULL}(?!\w)|{_STREET_ABBR}(?:\.|(?!\w)))({_UNIT})", re.I)
#: Where an English or French address may begin.
_HOUSE_AT = re.compile(rf"{_HOUSE}(?: ?(?:bis|ter|quater)(?!\w))?,? (?=[^\W\d_])", re.I)
_NOT_STREET = frozenset(
    "hour hours day days minute minutes seed seeds lane lanes drive draws draw of the a an and or in on at to for with from by is was are were "
    "job jobs chunk chunks trial trials step steps worker workers slot slots free mb ms gb rows row survivors survivor table tables retries "
    "more no not its his her our their this that these those all both each every per last first next best top".split()
)
_AFTER_STREET = re.compile(r"\s+(?:maps?|agreement|slots?|of trials|of)\b", re.I)
_FR_WAY = r"(?:rue|impasse|avenue|all[ée]e|boulevard|chemin|quai|place|ruelle|sentier|cours|square|passage|av\.|bd\.?)"
_FR_LINK = r"(?:de la |de l['’]|de |du |des |d['’])"
_ADDRESS_FR = re.compile(rf"{_HOUSE}(?: ?(?:bis|ter|quater)(?!\w))?,? {_FR_WAY} ((?:{_FR_LINK})?{_NAMEWORD}(?: (?:{_FR_LINK})?{_NAMEWORD}){{0,4}})", re.I)
_FR_TAIL = re.compile(rf"(?i:{_FR_LINK})?(?:[A-ZÀ-ÖØ-Þ][\w'’-]*(?: (?i:{_FR_LINK})?[A-ZÀ-ÖØ-Þ][\w'’-]*){{0,3}}|[^\W\d_][\w'’-]*(?: (?!(?:is|and|not|hacia|or|und|et|y)\b)(?:{_FR_LINK})?[a-zß-öø-ÿ][\w'’-]*){{0,2}})")
_ADDRESS_DE = re.compile(r" \d{1,4}(?: ?[a-zA-Z](?!\w))?(?!\w)")
_DE_END = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ufer", "damm", "stieg", "ring")
_DE_HEAD = re.compile(r"(?:(?<!\w)(?:Alte[rns]?|Neue[rns]?|Am|An der|Auf der|Gro(?:ß|ss)e|Kleine|Obere|Untere|Hintere|Lange) )?(?<![\w-])[^\W\d_][\w-]*$", re.I)
_ES_WAYS = ("calle", "c/", "avda", "avenida", "av.", "plaza", "pza", "paseo", "camino", "ronda", "traves", "carrera")
_ADDRESS_ES = re.compile(r"(?<!\w)(?:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|ronda|traves[íi]a|carrera) ?(?:(?:de los|de las|de la|del|de) )?[^\W\d_][\w'’-]*(?: (?:(?:de los|de las|de la|del|de) )?[^\W\d_][\w'’-]*){0,3},? (?:n\.? ?[ºo°]\.? ?|núm\.? ?)?\d{1,4}(?!\w)(?: ?(?:bis))?(?:, ?\d{1,2}\.? ?[ºª°]\.?(?: ?[A-Z](?!\w))?)?", re.I)

# ---- names -----------------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_][\w\u0300-\u036f]*+(?:['’](?=[^\W\d_]{2})[\w\u0300-\u036f]*+)*+(?:[-‐‑][^\W\d_][\w\u0300-\u036f]*+)*+")
_PARTICLES = frozenset("de del della di da van von der den dem zu zum la las los le du des ter ten y e".split())
_TITLES = frozenset("dr mr mrs ms miss prof herr frau sr sra srta don doña dona mme mlle m monsieur madame dott ing".split())
#: Words that stand before a name, capitalised at a sentence's start or in a heading, and aren't given names.
_NOT_GIVEN = frozenset(
    "a after an and as ask at badge before between but by call cc contact contacto contacte con copy de del dear delivery der die el en engineer entre esta "
    "fiche for form from gracias grace hello hi hola i in is it its kontakt la laut le les llama mail merci mit name no note notes of off on operator or "
    "owner para per please por que questions rappeler re reporter reviewed reviewer relu said says see según segun selon ship signed since so talked "
    "team thanks the then to und une user von von was we when who with y you your et bei au aux an am from if not only via this that "
    "revisado ruckruf gepruft segun payroll copy until up while than about his her their our new starter engineer engineers visitor keys".split()
) - {"grace"}
#: Everyday given names, for texts in which no family name of the lexicon's kinds follows. A fixed list.
_MORE_GIVEN = frozenset(
    "owen tessa orla rhea silas belen elodie sonke torben nuria gael anais kathe marisol lucia joaquin tomas remi loic maelle oceane solene thibault capucine "
    "jonas anna emma oliver jack harry george noah arthur leo oscar henry william james thomas alice mary john robert michael david sarah laura "
    "emily lucy hannah sophie charlotte olivia amelia isla ava ella peter paul simon andrew daniel matthew luke adam alexander benjamin samuel joseph "
    "maria jose carlos luis juan pedro pablo javier miguel diego sofia carmen elena isabel teresa ines sergio andres raul hans klaus "
    "inigo aitor unai ane leire marta alba julia raquel beatriz pilar rosa manuel antonio francisco fernando alvaro jorge ruben oriol nerea amaia gorka "
    "jurgen wolfgang ursula monika petra stefan andreas markus lena lukas felix moritz sabine ingrid pierre jean marie claire camille julien nicolas "
    "antoine louis chloe manon lea hugo lucas jules margaux helene francois amelie bjarne heike ulrike greta frieda detlef anneliese cormac brenna".split()
)
#: Everyday family names, of which the second line are ordinary words as well. A fixed list.
_MORE_FAMILY = frozenset(
    "smith jones taylor brown williams wilson johnson davies evans thomas roberts walker robinson thompson hughes edwards garcia martinez lopez gonzalez rodriguez perez "
    "stone marsh brook brooks wood woods hill lake rivers banks frost snow summers west north moor heath forest ford glen vale shaw bush fox wolf swift "
    "sanchez ramirez torres fernandez gomez muller schmidt schneider fischer weber meyer wagner becker schulz hoffmann dubois moreau laurent lefebvre".split()
)
_NAME_GAP = re.compile(r"[ \t   ]{1,3}$|[ \t ]?\r?\n[ \t]?$")


def fold(w: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(c)).replace("ß", "ss")


class Names:
    """What is known of name words: lexicon, and family names by beginning and ending."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        self.given = {fold(p) for p, kind, _ in parts if kind == "given"} | _MORE_GIVEN
        self.family = {fold(p) for p, kind, _ in parts if kind == "family"}
        self.ordinary = {fold(w) for w in _ORDINARY} | (_MORE_FAMILY - self.family)
        ends: dict[str, set[str]] = defaultdict(set)
        for w in self.family:
            for i in range(3, len(w) - 1):
                ends[w[i:]].add(w[:i])
        # beginnings that take several long endings of which each is shared; then all endings after such beginnings
        shared = {e for e, b in ends.items() if len(b) >= 3 and len(e) >= 4}
        heads: dict[str, set[str]] = defaultdict(set)
        for e in shared:
            for b in ends[e]:
                heads[b].add(e)
        first = set(heads)
        self.heads = {b for b in first if not any(b != a and b.startswith(a) and heads[b] <= {x[len(b) - len(a) :] for x in heads[a]} for a in first)}
        self.longest = max(map(len, self.heads), default=0)
        tails: dict[str, set[str]] = defaultdict(set)
        for w in self.family:
            for b in self.heads:
                if w.startswith(b) and len(w) > len(b) + 1:
                    tails[w[len(b) :]].add(b)
        self.tails = {e for e, b in tails.items() if len(b) >= 2}
        self.family |= _MORE_FAMILY
        self._seen: dict[str, int] = {}

    def kind(self, w: str) -> int:
        """1: given name, 2: family name, 4: family name also by form only."""
        k = self._seen.get(w)
        if k is None:
            f = fold(w)
            k = (f in self.given) + 2 * (f in self.family)
            if not k & 2 and self._formed(f):
                k |= 6
            for part in re.split(r"[-‐‑]", f) if not k & 2 and ("-" in f or "‐" in f or "‑" in f) else ():
                if part in self.family or self._formed(part):
                    k |= 2
                elif part in self.given:
                    k |= 1
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[w] = k
        return k

    def _formed(self, f: str) -> bool:
        return any(f[:i] in self.heads and f[i:] in self.tails for i in range(3, min(len(f) - 1, self.longest + 1)))


#: Nouns that often follow a given name which is a word as well, in capitals.
_NOT_FAMILY = frozenset(
    "seed seeds pool pools period periods window windows sieve sieves street road lane drive avenue close terrace court way place square team phase session "
    "run report draw draws chunk job monitor optimizer step trial score scores survivors table note notes the and or of to for in on at is was has says said "
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec monday tuesday "
    "wednesday thursday friday saturday sunday wrote left restarted changed".split()
)


def _names(text: str, names: Names) -> Iterator[tuple[int, int]]:
    kind, known = names.kind, names._seen
    # most texts hold no word of a name
    kinds = [known[w] if w in known else kind(w) for w in _WORD.findall(text)]
    if not any(kinds):
        return
    toks = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    n = len(toks)

    def gap(i: int) -> str:
        return text[toks[i][1] : toks[i + 1][0]]

    def joined(i: int) -> bool:
        """Only white space between words i and i + 1, or the dot of an initial."""
        g = gap(i)
        if len(toks[i][2]) == 1 and toks[i][2].isupper() and g[:1] == ".":
            return g == "." or bool(_NAME_GAP.match(g[1:]))
        return bool(_NAME_GAP.match(g))

    def initial(i: int) -> bool:
        return len(toks[i][2]) == 1 and toks[i][2].isupper() and text[toks[i][1] : toks[i][1] + 1] == "."

    def given(i: int, by_form: bool) -> bool:
        w = toks[i][2]
        if names.kind(w) & 1:
            return True
        f = fold(w)
        if f in _NOT_GIVEN or f in _TITLES or f in _PARTICLES or len(w) < 2:
            return False
        return by_form and w[0].isupper() and (w.isupper() or w[1:].replace("-", "").replace("’", "").islower() or "-" in w)

    i = done = 0
    while i < n:
        s, e, w = toks[i]
        k = kinds[i]
        # neither a family name nor a word in capitals near a given name
        if not k & 2 and not (w[0].isupper() and (i and kinds[i - 1] or i > 1 and kinds[i - 2] or i > 2 and kinds[i - 3] or i > 3 and kinds[i - 4])):
            i += 1
            continue
        # an unknown word in capitals after a given name, straight or after initials and particles
        if not k & 2 and w[0].isupper() and len(w) > 2 and fold(w) not in _NOT_FAMILY and i - 1 >= done and joined(i - 1) and "\n" not in gap(i - 1):
            m = i - 1
            while m - 1 >= done and joined(m - 1) and i - m < 4 and (initial(m) or toks[m][2] in _PARTICLES):
                m -= 1
            g = toks[m][2]
            next_family = k & 1 and i + 1 < n and joined(i) and names.kind(toks[i + 1][2]) & 2
            if names.kind(g) & 1 and g[0].isupper() and len(g) > 1 and w.isupper() == g.isupper() and not next_family:
                yield toks[m][0], e
                done = i = i + 1
                continue
        if not k & 2 or (w[0].islower() and k & 1 and not k & 4):
            i += 1
            continue
        # to the left: particles, initials or second names, then the given name or initial
        j, parts = i - 1, 0
        while j >= done and joined(j) and fold(toks[j][2]) in _PARTICLES and not initial(j) and parts < 3:
            j, parts = j - 1, parts + 1
        found = None
        if j >= done and joined(j):
            m = j
            while m >= done and joined(m) and initial(m) and m > done and joined(m - 1) and (initial(m - 1) or given(m - 1, True)):
                m -= 1
            plain = w[0].islower()
            firm = k & 4 or fold(w) not in names.ordinary
            if given(m, firm and not plain) or (plain and k & 2 and given(m, False)):
                found = m
                if m - 1 >= done and joined(m - 1) and names.kind(toks[m - 1][2]) & 1 and not names.kind(toks[m][2]) & 2 and (toks[m - 1][2][0].isupper() or plain):
                    found = m - 1
            elif initial(m):
                found = m
        if found is not None:
            end = i
            if end + 1 < n and joined(end) and names.kind(toks[end + 1][2]) & 2 and toks[end + 1][2][0].isupper() == w[0].isupper() and not names.kind(toks[end + 1][2]) & 1:
                end += 1
            yield toks[found][0], toks[end][1]
            done = i = end + 1
            continue
        # family name, given name
        if i + 1 < n and re.fullmatch(r",[ \t ]{1,2}", gap(i)):
            m = i + 1
            nxt_family = m + 1 < n and joined(m) and names.kind(toks[m + 1][2]) & 2 and not initial(m)
            ok = names.kind(toks[m][2]) & 1 or initial(m) or (k & 2 and toks[m][2][0].isupper() and given(m, True))
            if ok and not nxt_family:
                start = i
                while start - 1 >= done and joined(start - 1) and fold(toks[start - 1][2]) in _PARTICLES and fold(toks[start - 1][2]) in ("van", "von", "de", "del") and toks[start - 1][2][0].islower() is False:
                    start -= 1
                end = toks[m][1] + (1 if initial(m) else 0)
                while m + 1 < n and joined(m) and initial(m + 1):
                    m += 1
                    end = toks[m][1] + 1
                yield toks[start][0], end
                done = i = m + 1
                continue
        i += 1


_ORDINARY = frozenset("Cross Field Price Winter Stone Pool Rose Mark May Grace Will Marsh Sunny Clover".split())


def _closed(text: str, at: int) -> bool:
    """After a name in an inverted form, no further word of the same sentence part directly."""
    return not re.match(r"[ \t ][a-z]+ed\b", text[at : at + 20]) or True


def _phone_end(s: str) -> int:
    """How much of a number with a country code belongs to it: as many digits as the country has."""
    d = re.sub(r"\D", "", re.split(r"(?i)[ ,]*(?:ext|x|poste|durchwahl|int)", s)[0])
    d = d[2:] if s.lstrip("(").startswith("00") else d
    lo, hi = (11, 11) if d[:1] == "1" else (12, 13) if d[:2] == "44" else (11, 12) if d[:2] == "33" else (11, 11) if d[:2] == "34" else (8, 15)
    return len(s) if lo <= len(d) <= hi else 0


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around its stretches of digits, that don't overlap."""
    out: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        a, b = max(0, m.start() - _BEFORE), min(len(text), m.end() + _BEHIND)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _within(r: re.Pattern, text: str, parts: list[tuple[int, int]]) -> Iterator[re.Match]:
    for a, b in parts:
        yield from r.finditer(text, a, b)


def _at(r: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Matches that begin at the given places and don't overlap."""
    done = 0
    for i in starts:
        if i >= done and (m := r.match(text, i)):
            done = m.end()
            yield m


def find_places(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all places, in the order of their start."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []

    def add(kind: str, s: int, e: int) -> None:
        i = bisect.bisect_right(starts, s)
        if e > s and not (i and ends[i - 1] > s) and not (i < len(starts) and starts[i] < e):
            starts.insert(i, s)
            ends.insert(i, e)
            out.append((kind, s, e))

    for r, hint in zip(_EMAIL, _EMAIL_HINT):
        done = 0
        for h in hint.finditer(text):
            # forms are shorter than what is looked at on both sides
            if h.start() >= done:
                lo = max(done, h.start() - 400)
                lo = max(lo, *(text.rfind(c, lo, h.start()) for c in _NOT_LOCAL))
                for m in r.finditer(text, lo, h.end() + 600):
                    if m.end() > h.start():
                        if m.start() <= h.start():
                            add("email", m.start(), m.end())
                            done = m.end()
                        break
    digits = re.search(r"\d", text)
    if digits:
        near = [x for x in _stretches(text) if _ANY_NUMBER.search(text, *x)]
        for r, label, back in ((_PASSPORT, _PASSPORT_END, 32), (_ID_LABELLED, _ID_LABEL_END, 48)):
            for m in _within(r, text, near):
                if label.search(text[max(0, m.start() - back) : m.start()]):
                    add("id_number", m.start(), m.end())
        for r in _ID:
            for m in _within(r, text, near):
                if not _NO_ID.search(text[max(0, m.start() - 14) : m.start()]):
                    add("id_number", m.start(), m.end())
        for m in _within(_PHONE[0], text, near):
            add("phone", m.start(), m.start() + _phone_end(m.group()))
        for r in _PHONE[1:]:
            for m in _within(r, text, near):
                if not _NO_ID.search(text[max(0, m.start() - 14) : m.start()]):
                    add("phone", m.start(), m.end())
        for m in _within(_PHONE_LABELLED, text, near):
            if _PHONE_LABEL_END.search(text[max(0, m.start() - 20) : m.start()]):
                add("phone", m.start(), m.end())
        houses = [m.start() for m in _HOUSE_AT.finditer(text)]
        for m in _at(_ADDRESS_EN, text, houses):
            words = m.group(1).split()
            if any(fold(w) in _NOT_STREET for w in words) or _AFTER_STREET.match(text, m.end()):
                continue
            add("address", m.start(), m.end())
        for m in _at(_ADDRESS_FR, text, houses):
            cut = _FR_TAIL.match(m.group(1))
            add("address", m.start(), m.start(1) + cut.end() if cut else m.end())
        low = text.lower()
        if any(x in low for x in _DE_END):
            for m in _ADDRESS_DE.finditer(text):
                before = text[max(0, m.start() - 200) : m.start()]
                if before.lower().endswith(_DE_END):
                    # the word that ends here, and what stands before it
                    end = next(x for x in _DE_END if before.lower().endswith(x))
                    h = _DE_HEAD.search(before[: len(before) - len(end)])
                    if h:
                        add("address", m.start() - len(end) - len(h.group()), m.end())
        if any(x in low for x in _ES_WAYS):
            for m in _ADDRESS_ES.finditer(text):
                add("address", m.start(), m.end())
    for s, e in _names(text, names):
        add("name", s, e)
    return sorted(out, key=lambda x: x[1])


# ---- entities and their replacements ---------------------------------------------------------------------------------

_SPELLED = re.compile(r"(?i)(?<=[\w\])])[ ]?(?:[(\[](at|dot)[)\]]|(?<= )(at|dot)(?= ))[ ]?")
_TITLED = re.compile(r"(?i)(?<!\w)(?:(mrs|ms|miss|frau|sra|señora|srta|señorita|doña|mme|mlle|madame|mademoiselle)|(mr|herrn?|sr|señor|monsieur))\.?[ \u00a0]$")


def titled(text: str, at: int) -> str | None:
    """The gender that a title straight before a name tells: f, m or none."""
    m = _TITLED.search(text[max(0, at - 16) : at])
    return m and ("f" if m.group(1) else "m")


def entity_key(kind: str, s: str) -> str:
    """The same for all writings of one entity."""
    if kind == "email":
        t = _SPELLED.sub(lambda m: "@" if (m.group(1) or m.group(2)).lower() == "at" else ".", s)
        return re.sub(r"\s", "", t).replace("＠", "@").casefold()
    if kind == "phone":
        d = re.sub(r"\D", "", s.replace("(0)", ""))
        return d[2:] if s.lstrip("(").startswith("00") else d
    if kind == "id_number":
        return re.sub(r"\W", "", s).upper()
    if kind == "name":
        return " ".join(_name_words(s))
    return " ".join(fold(s).replace(",", " ").split())


def _stream(secret: bytes, *what: object) -> Iterator[int]:
    """An endless keyed stream of bytes."""
    n = 0
    while True:
        yield from hmac.digest(secret, "\x1f".join(map(str, (*what, n))).encode(), hashlib.sha256)
        n += 1


#: Letters that may stand for each other: an alphabet's vowels, its consonants, letters with accents. No letter is in two.
_POOLS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäéèêëíìîïóòôöúùûü", "çñ", "аеиоуыэюяё", "бвгджзклмнпрстфхцчшщйъь", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_POOL_OF = {c: x for p in _POOLS for x in (p, p.upper()) for c in x}


@functools.cache
def _pool(c: str) -> str:
    """The characters that may stand for c, c among them: digits for digits, letters for letters of the same script and case. '' if c stays."""
    if c in _POOL_OF:
        return _POOL_OF[c]
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""
    block = map(chr, range(ord(c) & ~255, (ord(c) | 255) + 1))
    return "".join(x for x in block if x.isalpha() and x not in _POOL_OF and unicodedata.category(x) == unicodedata.category(c))


def _permuted(x: int, n: int, secret: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1: a Feistel network over the next even number of bits, repeated while it leads beyond n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    size, mask = half // 8 + 8, (1 << half) - 1
    start = hashlib.shake_256(b"%d\x1f%s%s\x1f%x" % (len(secret), secret, tweak.encode("utf-8", "surrogatepass"), n))
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            h = start.copy()
            h.update(b"\x1f%d\x1f%x" % (r, right))
            left, right = right, left ^ (int.from_bytes(h.digest(size), "big") & mask)
        x = left << half | right
        if x < n:
            return x


def _recode(s: str, secret: bytes, tweak: str, stay: Collection[int] = ()) -> str:
    """Another text of the form of s (see ``_pool``; the places in ``stay`` stay): one to one, so that no two texts become the same."""
    out, pools = list(s), [(i, p) for i, c in enumerate(s) if i not in stay and (p := _pool(c))]
    x, n = 0, 1
    for i, p in pools:
        x, n = x * len(p) + p.index(s[i]), n * len(p)
    if n > 1:
        x = _permuted(x, n, secret, tweak)
    for i, p in reversed(pools):
        x, k = divmod(x, len(p))
        out[i] = p[k]
    return "".join(out)


#: From this attempt on candidates are longer than what they replace, by one character more each time.
LONGER = 4


def candidate(kind: str, key: str, attempt: int, secret: bytes, pools: dict[str, list[str]]) -> str:
    """A replacement of an entity's key; each attempt gives another one.

    All kinds but names are recoded one to one within their form, so that those of one attempt only meet what other attempts gave.
    Names are drawn from the pools, then with double family names, then recoded.
    """
    again = f" {attempt}" if attempt else ""
    rnd = _stream(secret, kind, key, attempt)
    more = "".join("0123456789"[next(rnd) % 10] for _ in range(attempt - LONGER + 1))
    if kind == "email":
        local, _, domain = key.partition("@")
        labels = domain.split(".")
        host = ".".join([_recode(x, secret, "host") for x in labels[:-1]] + labels[-1:])
        return f"{more}{_recode(local, secret, f'email {domain}{again}')}@{host}"
    if kind == "phone":
        first = min(3, max(0, len(key) - 7))
        return more + _recode(key, secret, f"phone {key[:first]}{again}", range(first))
    if kind == "id_number":
        return more + _recode(key, secret, kind + again)
    if kind == "name":
        return _other_name(key.split(), attempt, rnd, secret, pools)
    stay = {i for m in re.finditer(r"\S+", key) if _FIXED_WORD.fullmatch(m.group()) for i in range(*m.span())}
    return _recode(key, secret, f"{kind} {attempt}", stay) + more


_INITIALS = "abcdefghijklmnoprstuvw"


def _other_name(words: list[str], attempt: int, rnd: Iterator[int], secret: bytes, pools: dict[str, list[str]]) -> str:
    """Given names, initials and particles as in ``words``, then a family name."""
    number = lambda n: (next(rnd) * 65536 + next(rnd) * 256 + next(rnd)) % n
    if not words or attempt >= 3 or not all(unicodedata.name(c, "").startswith("LATIN") for w in words for c in w if c.isalpha()):
        # another script, or no names left: the letters are recoded, longer ones where these are taken too
        tail = "".join(_INITIALS[number(len(_INITIALS))] for _ in range(attempt - LONGER + 1))
        return " ".join(w if w in _PARTICLES else _recode(w, secret, f"name {attempt}") for w in words) + tail
    lang, sex = name_class(words, pools)
    pick = lambda pool: fold(pool[number(len(pool))])
    initial = lambda: _INITIALS[number(len(_INITIALS))]
    given = [pick(pools.get(f"given-{lang}-{sex}") or pools["given"]) if len(w) > 1 else initial() for w in words[:1]]
    mid = [initial() if len(w) == 1 else w if w in _PARTICLES else pick(pools["given"]) for w in words[1:-1]]
    fam = pick(pools.get(f"family-{lang}") or pools["family"])
    if "-" in words[-1] or attempt:
        fam += "-" + pick(pools["family"])
    return " ".join([*given, *mid, fam])


_FIXED_WORD = re.compile(
    r"(?:\W|" + _STREET_FULL + "|" + _STREET_ABBR + r"|apartment|apt|flat|unit|suite|floor|bis|ter|n\.?o?\.?|"
    r"rue|impasse|avenue|allee|boulevard|chemin|quai|place|calle|c/|avda|avenida|plaza|paseo|camino|de|del|des|du|la|los|las|alte|neue|am)\.?"
)


def name_class(words: list[str], pools: dict[str, list[str]]) -> tuple[str, str]:
    """Language and gender of a name: what the lexicon knows, what titles told of the given name, else what its ending tells."""
    lang = next((x for w in reversed(words) for x in pools.get(f"lang:{w}", ())), "en")
    g = words[0]
    known = pools.get(f"sex:{g}")
    return lang, known[0] if known else "f" if g.endswith(("a", "ie", "ine")) and len(g) > 2 else "m"


def make_pools(parts: list[tuple[str, str, str]], sexes: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Name parts by kind, language and gender; ``sexes`` tells the gender of given names in lower case without accents."""
    pools: dict[str, list[str]] = defaultdict(list, {f"sex:{g}": [x] for g, x in (sexes or {}).items()})
    for part, kind, lang in sorted(parts):
        pools[kind].append(part)
        pools[f"lang:{fold(part)}"].append(lang)
        pools[f"family-{lang}" if kind == "family" else f"given-{lang}-{name_class([fold(part)], pools)[1]}"].append(part)
    pools["given"] = pools["given"] or ["Alex"]
    pools["family"] = pools["family"] or ["Doe"]
    return dict(pools)


def _name_words(s: str) -> list[str]:
    """The words of a name, given names first."""
    if "," in s:
        a, _, b = s.partition(",")
        s = f"{b} {a}"
    return [w for w in (fold(x).strip(".") for x in s.split()) if w]


def render(kind: str, seen: str, new: str) -> str:
    """The replacement in the writing that was found: order, case, separators, initials, spelled-out signs."""
    if kind == "name":
        words, was = new.split(), _name_words(seen)
        given, fam = words[:-1], words[-1]
        # an initial for an initial, and no more given names than were there
        given = [w if w in _PARTICLES and w == o else w[:1] if len(o) == 1 else w for w, o in zip(given, was[:-1])]
        up = lambda w: "-".join(p[:1].upper() + p[1:] for p in w.split("-"))
        given = [up(w) + "." if len(w) == 1 else w if w in _PARTICLES else up(w) for w in given]
        t = f"{up(fam)}, {' '.join(given)}" if "," in seen else " ".join([*given, up(fam)])
        letters = [c for c in seen if c.isalpha()]
        return t.upper() if len(letters) > 3 and seen.upper() == seen else t.lower() if seen.lower() == seen else t
    if kind == "address":
        words = new.split()
        it = iter(words)
        return re.sub(r"[^\s,]+", lambda m: _cased(m.group(), next(it, m.group())), seen)
    keep = set()
    if kind == "email":
        for m in _SPELLED.finditer(seen):
            keep |= set(range(m.start(), m.end()))
    if kind == "phone":
        keep |= {m.start() + 1 for m in re.finditer(r"\(0\)", seen)}
        keep |= {0, 1} if seen.startswith("00") else {1, 2} if seen.startswith("(00") else set()
        keep |= {i for i, c in enumerate(seen) if not c.isdecimal()}
    # a character that lower case makes several of, in the key of an e-mail address, takes as many
    many = lambda c: sum(x.isalnum() for x in c.casefold()) if kind == "email" else 1
    letters = [c for c in new if c.isalnum()]
    places = [i for i, c in enumerate(seen) if i not in keep and c.isalnum()]
    # what a longer replacement has more stands before the first place
    extra = max(0, len(letters) - sum(many(seen[i]) for i in places))
    chars, out = iter(letters[extra:]), list(seen)
    for i in places:
        out[i] = _cased(seen[i], "".join(next(chars, "") for _ in range(many(seen[i]))))
    if places and extra:
        out[places[0]] = "".join(letters[:extra]) + out[places[0]]
    return "".join(out)


def _cased(like: str, s: str) -> str:
    return s.upper() if like.upper() == like and like.lower() != like else s[:1].upper() + s[1:] if like[:1].isupper() else s


# ---- Spark -----------------------------------------------------------------------------------------------------------

#: The lexicon of name parts goes to every executor; it is refused beyond this many rows.
MOST_PARTS = 200_000
PLACE = "array<struct<kind:string,start_pos:int,end_pos:int,entity:string,title:string>>"


def lexicon(parts: DataFrame) -> list[tuple[str, str, str]]:
    """name_part, part_kind, lang of a lexicon of proven size."""
    rows = parts.select("name_part", "part_kind", "lang").where("name_part IS NOT NULL").limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"a lexicon of more than {MOST_PARTS} name parts")
    return [(r[0], r[1], r[2] or "en") for r in rows]


def entities(text: str | None, names: Names) -> list[dict]:
    """The places of a text with their entities. An initial with a family name is the one full name of the text that it fits, if there is only one."""
    out = [{"kind": k, "start_pos": a, "end_pos": b, "entity": entity_key(k, text[a:b]), "title": titled(text, a) if k == "name" else None} for k, a, b in find_places(text, names)]
    full: dict[tuple, set[str]] = defaultdict(set)
    for p in out:
        w = p["entity"].split() if p["kind"] == "name" else ()
        if len(w) > 1 and len(w[0]) > 1:
            full[w[0][0], w[-1]].add(p["entity"])
    for p in out if full else ():
        w = p["entity"].split()
        if p["kind"] == "name" and len(w) > 1 and len(w[0]) == 1 and len(one := full.get((w[0], w[-1]), ())) == 1:
            p["entity"] = next(iter(one))
    return out


def places(df: DataFrame, ident: str, text: str, parts: list[tuple[str, str, str]], mask: bool = False) -> DataFrame:
    """ident, places (with each entity's key) and, with ``mask``, the text with typed placeholders, numbered by entity within the text."""
    src = spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")))
    schema = f"_id {src.schema['_id'].dataType.simpleString()}, places {PLACE}" + (", masked string" if mask else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(parts)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [entities(t, names) for t in texts]
            cols = [b.column(0), pa.array(out, _PLACE_TYPE)] + ([pa.array([_masked(t, x) for t, x in zip(texts, out)], pa.string())] if mask else [])
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "places"] + (["masked"] if mask else []))

    return src.mapInArrow(run, schema).withColumnRenamed("_id", ident)


_PLACE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("entity", pa.string()), ("title", pa.string())]))


def _masked(text: str | None, found: list[dict]) -> str | None:
    if not found:
        return text
    out, at, no = [], 0, {}
    for p in found:
        mine = no.setdefault(p["kind"], {})
        out += [text[at : p["start_pos"]], f"[{p['kind'].upper()}_{mine.setdefault(p['entity'], len(mine) + 1)}]"]
        at = p["end_pos"]
    return "".join([*out, text[at:]])


def genders(each: DataFrame, parts: list[tuple[str, str, str]]) -> dict[str, str]:
    """The gender of the lexicon's given names, by the titles before them in all documents; at most one entry per name of the lexicon."""
    spark = each.sparkSession
    known = spark.createDataFrame(sorted({(fold(p),) for p, kind, _ in parts if kind == "given"}), "given string")
    t = each.where("kind = 'name' AND title IS NOT NULL").select(F.substring_index("entity", " ", 1).alias("given"), F.when(F.col("title") == "f", 1).otherwise(-1).alias("x"))
    votes = t.join(F.broadcast(known), "given", "left_semi").groupBy("given").agg(F.sum("x").alias("x")).where("x <> 0")
    return {r.given: "f" if r.x > 0 else "m" for r in votes.collect()}


#: Candidates that a name draws in a round, as two names often draw the same.
DRAWS = 4


def replacements(entities: DataFrame, secret: str, parts: list[tuple[str, str, str]], sexes: dict[str, str] | None = None) -> DataFrame:
    """kind, entity, replacement for distinct entities; no replacement is there twice or is an entity.

    In each round every entity that has none yet draws a candidate, names ``DRAWS`` of them. A candidate that is one of the entities, or was given in
    an earlier round, is nobody's; of those that draw one, the entity with the earliest attempt, then the first by name, has it, and
    an entity that has several keeps its earliest. All checks are shuffles on (kind, candidate) or aggregates that combine on the
    map side, so that no candidate that many draw comes into one task. The rounds end when every entity has one.
    """
    pools, key = make_pools(parts, sexes), secret.encode()
    schema = "kind string, entity string, attempt int, replacement string"

    def draw(no: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, e, a, candidate(k, e, a, key, pools)) for k, e in zip(*(c.to_pylist() for c in b.columns)) for a in (range(no * DRAWS, (no + 1) * DRAWS) if k == "name" else (no,))]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["kind", "entity", "attempt", "replacement"])

        return run

    known = written(entities.select("kind", "entity").where("entity IS NOT NULL").distinct(), "entities")
    taken, left, done, no, rest = known.select("kind", F.col("entity").alias("replacement")), known, None, 0, known.count()
    while True:
        won = spread(left).mapInArrow(draw(no), schema).groupBy("kind", "replacement").agg(F.min(F.struct("attempt", "entity")).alias("w"))
        won = won.join(taken, ["kind", "replacement"], "left_anti").groupBy("kind", F.col("w.entity").alias("entity")).agg(F.min(F.struct("w.attempt", "replacement")).alias("r"))
        ok = written(won.select("kind", "entity", F.col("r.replacement").alias("replacement")), "surrogates")
        done, rest = ok if done is None else done.unionByName(ok), rest - ok.count()
        if rest <= 0:
            return done
        left = written(left.join(ok, ["kind", "entity"], "left_anti"), "left")
        taken, no = taken.unionByName(ok.select("kind", "replacement")), no + 1


def replaced(df: DataFrame, ident: str, text: str, parts: list[tuple[str, str, str]], secret: str) -> DataFrame:
    """ident, kind, start_pos, end_pos, entity, replacement: every place with the keyed surrogate of its entity.

    Places are found once and written. Entities that very many places name (a signature) are joined apart from all others.
    """
    found = written(places(df, ident, text, parts).where(F.size("places") > 0), "places")
    each = found.select(ident, F.explode("places").alias("p")).select(ident, "p.*")
    per = written(each.groupBy("kind", F.col("entity").alias("key")).agg(F.count(F.lit(1)).alias("n")), "counts")
    heavy = heavy_keys(per, ["kind"]).withColumnRenamed("key", "entity").select("kind", "entity")
    new = replacements(per.select("kind", F.col("key").alias("entity")), secret, parts, genders(each, parts))
    on = ["kind", "entity"]
    return split_join(each.drop("title"), new, on, heavy, on, "inner").select(ident, "kind", "start_pos", "end_pos", "entity", "replacement")


def surrogates(df: DataFrame, ident: str, text: str, parts: list[tuple[str, str, str]], secret: str) -> DataFrame:
    """ident, text with every place replaced by the keyed surrogate of its entity."""
    new = replaced(df, ident, text, parts, secret)
    per = new.groupBy(ident).agg(F.collect_list(F.struct("start_pos", "end_pos", "kind", "replacement")).alias("subs"))

    @F.pandas_udf("string")
    def put(t, subs):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([replaced_text(a, b) for a, b in zip(t, subs)], dtype=object)

    return df.select(ident, F.col(text).alias("_t")).join(per, ident, "left").select(ident, put(F.col("_t"), F.col("subs")).alias("text"))


def replaced_text(s: str | None, subs: Iterable[dict] | None) -> str | None:
    """A text with its places (start_pos, end_pos, kind, replacement) replaced."""
    if s is None or subs is None:
        return s
    out, at = [], 0
    for p in sorted(subs, key=lambda p: p["start_pos"]):
        a, e = p["start_pos"], p["end_pos"]
        out += [s[at:a], render(p["kind"], s[a:e], p["replacement"])]
        at = e
    return "".join([*out, s[at:]])


def surrogate_report(df: DataFrame, ident: str, text: str, parts: list[tuple[str, str, str]], secret: str) -> DataFrame:
    """Per kind, as rendered: entities; shared (writings of two entities that came out as one), real (replacements that are an entity of
    the corpus) and split (entities of which two writings came out as two). ``ident`` must be unique."""
    new = written(replaced(df, ident, text, parts, secret), "replaced")
    per = new.groupBy(ident).agg(F.collect_list(F.struct("kind", "start_pos", "end_pos", "entity", "replacement")).alias("subs"))
    schema = "kind string, entity string, initial boolean, written string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, subs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in subs:
                    seen = t[p["start_pos"] : p["end_pos"]]
                    w = entity_key(p["kind"], render(p["kind"], seen, p["replacement"]))
                    # an initial stands for what it is short for
                    short = p["kind"] == "name" and [len(x) == 1 for x in _name_words(seen)] != [len(x) == 1 for x in p["entity"].split()]
                    rows.append((p["kind"], p["entity"], short, w))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["kind", "entity", "initial", "written"])

    w = df.select(ident, F.col(text).alias("_t")).join(per, ident).select("_t", "subs").mapInArrow(run, schema).distinct()
    w = written(w.where("NOT initial").select("kind", "entity", "written"), "writings")
    shared = w.select("kind", "entity", "written").distinct().groupBy("kind", "written").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.sum((F.col("n") > 1).cast("int")).alias("shared"))
    split = w.groupBy("kind", "entity").agg(F.countDistinct("written").alias("n")).groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.sum((F.col("n") > 1).cast("int")).alias("split"))
    known = w.select("kind", F.col("entity").alias("written")).distinct()
    real = w.join(known, ["kind", "written"], "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("real"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return split.join(shared, "kind", "left").join(real, "kind", "left").select("kind", zero("entities"), zero("shared"), zero("real"), zero("split"))
