"""Personal information inside free text (problem 8): a semi-Markov conditional random field over candidate segments.

Cheap patterns propose whole spans, several boundaries for each; a span is scored as a whole, with features of its own
shape and of the words around it, for each type it may have. For every cluster of overlapping candidates a dynamic
program finds the best set of disjoint typed spans; text outside spans scores 0. The weights are fitted here, by
gradient ascent on the conditional likelihood of the annotated sentences of pii_training, once where a query is built.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm import pii_training

Span = tuple[int, int, str]

_LATIN = [chr(k) for k in range(0xC0, 0x250)]
_CAP, _LOW = "A-Z" + "".join(c for c in _LATIN if c.isupper()), "a-z" + "".join(c for c in _LATIN if c.islower())
_PARTICLE = r"(?:von|van|de la|de|del|der|du|da|di|le|VON|VAN|DE)"
_NAME_WORD = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:['’\-]\p{Lu}?\p{Ll}+)*|\p{Lu}(?:['’]\p{Lu}|\p{Lu})+(?:-\p{Lu}{2,})*)"
_INITIAL = r"\p{Lu}\.(?:-?\p{Lu}\.)*"
NAME = regex.compile(rf"(?<![\w@.&])(?:{_NAME_WORD}|{_INITIAL})(?:(?:, | )(?:{_PARTICLE} )?(?:{_NAME_WORD}|{_INITIAL}))+(?![\w@])")
NAME_TOKEN = regex.compile(rf"{_PARTICLE}(?= )|{_INITIAL}|{_NAME_WORD}")
#: A name has at most so many words and initials beside its particles.
NAME_TOKENS = 5

_AT = r"(?:@| @ | ?[(\[{]at[)\]}] ?|&#64;| ?[(\[]arroba[)\]] ?| at (?=[\w\-]+ dot ))"
_DOT = r"(?:\.| ?[(\[{]dot[)\]}] ?| ?[(\[]punto[)\]] ?| dot )"
_AT_HINT = re.compile(r"&#64;|[(\[{](?:at|arroba)[)\]}]| dot ", re.I)
EMAIL = re.compile(rf"(?<![\w.+\-])[\w](?:[\w.+\-]*\w)?{_AT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+", re.I)

_GROUP = r"(?:[A-Z]{0,2}\d[0-9A-Z]*|[A-Z](?![\w'’]))(?![a-z])"
NUMBER = re.compile(rf"(?<![\w.,/\-])(?:\+ ?|\(\+?(?=\d))?(?:[A-Z]{{2}} (?=\d))?{_GROUP}(?:(?:\) ?|[ \-./]\(?|/\(?){_GROUP})*")
EXTENSION = re.compile(r",? ?(?:ext\.?|x|extension|poste|Durchwahl|DW|App\.|Nebenstelle|int\.|extensión|ext\.:) ?\d{1,5}(?!\w)", re.I)

_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Drive|Dr\.|Way|Court|Ct\.|Square|Row|Hill|Terrace|Place|Crescent|Boulevard|Blvd\.?|Gardens|Grove|Mews|Walk|Parkway|Pkwy\.?|View|Rise|Green|Park|Quay|Circle|Trail|Wharf|Gate|Highway|Hwy\.?|Plaza|Alley)"
STREET_WORDS = frozenset(w.rstrip("?.\\").lower() for w in _STREET_EN[3:-1].split("|")) | frozenset("""
calle camino plaza paseo avenida avda ronda travesía cuesta carretera callejón rue boulevard place impasse quai chemin cours passage
straße strasse weg gasse allee platz ufer damm ring via viale piazza corso largo""".split())
_ENDS_STREET = re.compile(rf" {_STREET_EN}(?:,? .*)?$")
_UNIT = r"(?:Unit|Flat|Apt\.?|Apartment|Suite|Floor|Room|Ste\.?)"
ADDRESS = [
    re.compile(rf"(?<![\w])(?:{_UNIT} \w{{1,5}}, )?\d{{1,5}}[A-Z]? (?:[A-Z][\w'’\-]+\.? ){{1,4}}?{_STREET_EN}(?![\w])(?:,? (?:{_UNIT} \w{{1,5}}|\d{{1,2}}(?:st|nd|rd|th) [Ff]loor))?"),
    re.compile(
        rf"(?<![\w])(?:(?:[{_CAP}][{_LOW}]+[\- ]){{0,2}}[{_CAP}][{_LOW}]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|graben|markt)"
        rf"|(?:[{_CAP}][{_LOW}]+[\- ]){{1,2}}(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ufer|Damm|Ring)"
        rf"|(?:Am|Zum|Zur|Im|An der|An den|Auf dem|Auf der|In der|Beim|Unter den|Hinter der) (?:[{_CAP}][{_LOW}]+ ?){{1,2}}) ?\d{{1,4}}(?: ?[a-z](?![\w]))?(?:, ?\d\. (?:OG|Stock|Etage)| ?// ?\d+|, (?:EG|DG|Whg\.? ?\d+))?"
    ),
    re.compile(
        r"(?<![\w])\d{1,4}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|r\.|bd|bld|boulevard|avenue|av\.|impasse|place|pl\.|quai|chemin|ch\.|allée|cours|passage|sentier|square|route)"
        rf" (?:(?:de la|de l['’]|de|du|des|aux|au|à la|d['’]|le|la|les) ?)?(?:[{_CAP}][\w'’\-]+)(?: (?:(?:de la|de|du|des|et) )?[{_CAP}][\w'’\-]+){{0,2}}(?:, (?:appt\.? ?\w+|apt\.? ?\w+|bât\.? ?\w+|étage \d+|\d+e étage))?"
    ),
    re.compile(
        r"(?<![\w])(?:Calle|C/|C\.|Camino|Plaza|Pza\.|Pl\.|Paseo|P\.º|Avenida|Avda\.|Av\.|Ronda|Travesía|Cuesta|Carretera|Ctra\.|Callejón|Via|Viale|Piazza|Corso|Largo) ?(?:(?:de las|de los|de la|del|de) )?"
        rf"[{_CAP}][\w\-]+(?: (?:(?:de la|del|de|y) )?[{_CAP}][\w\-]+){{0,2}},? (?:n[º°.]?\.? ?|núm\. ?|número )?\d{{1,4}}(?: ?[A-Z](?![\w]))?(?:, (?:bajo|ático|entlo\.?|\d+[.º°ª]+ ?(?:[A-Z]|izda\.?|dcha\.?)?))?"
    ),
]

#: A street type after another one: Old Quay Row.
LONGER_STREET = re.compile(rf" {_STREET_EN}(?![\w])(?:,? (?:{_UNIT} \w{{1,5}}|\d{{1,2}}(?:st|nd|rd|th) [Ff]loor))?")

_NUMBER_FIRST = re.compile(r"(?<!\w)\d{1,5}(?=[A-Z]? [A-Z]|(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|r\.|b[dl]|boul|av|imp|pl|quai|ch|all|cours|pass|sent|squ|route))")
_NUMBER_LAST = re.compile(rf"[{_CAP}][\w'’\-]*\.?,? ?(?:n[º°.]{{0,2}} ?|núm\. ?|número )?(\d{{1,4}})(?!\d)")
_UNIT_BEFORE = re.compile(rf"(?<!\w){_UNIT} \w{{1,5}}, $")
_BEHIND = re.compile(
    r"(?:[sS]tra(?:ß|ss)e|[sS]tr\.|[wW]eg|[gG]asse|[aA]llee|[pP]latz|[uU]fer|[dD]amm|[rR]ing|steig|graben|markt) ?$"
    r"|\b(?:A[mn]|Zu[mr]|Im|Auf|In|Beim|Unter|Hinter|Calle|C[/.]|Camino|Pl?za|Plaza|Pl\.|Paseo|P\.º|Av|Ronda|Travesía|Cuesta|Ctra|Carretera|Callejón|Via|Piazza|Corso|Largo)"
)

# Titles, and closed-class words that begin a sentence or a heading and are no part of a name.
TITLES = frozenset("dr prof mr mrs ms mme mlle sr sra srta frau herr don doña monsieur madame sir captain judge mayor father sister maître docteur professor".split())
FUNCTION = frozenset("""
the a an in on at by of for to from with and or but as if when while after before since during each every two three this that these those his her its their
some many most all both no not there here it he she they we you i my our your who what where why how then thus also only even once
der die das den dem des ein eine einen einem einer und oder aber als wenn nach vor seit bei mit von zu zum zur im am an auf aus für über unter er sie es wir ihr man
jeder jede jedes dieser diese dieses alle viele kein keine dort hier dann so auch nur doch weil laut wer was wo wie
le la les l un une des du de au aux et ou mais si quand après avant depuis chaque ce cet cette ces il elle ils elles on nous vous je son sa ses leur leurs selon vers par pour sans sous sur dans en dès plus
el los las uno una unos unas del al y o pero cuando tras desde cada este esta estos estas ese esa él ella ellos ellas su sus según hacia por para sin sobre bajo entre hasta más no
""".split())  # fmt: skip
ARTICLES = frozenset("the a an der die das den dem des ein eine einen einem einer am im zum zur vom beim le la les un une du au aux el los las una al del".split())
STARTERS = FUNCTION | {"d'abord", "d'habitude", "ensuite", "puis", "mme", "m", "l'", "tél", "tel"}

_LEFT = re.compile(r"[^\W_]+[.:]?|[=|:(\[\]'\"<>!/#*]|\S")


def _shape(text: str) -> str:
    """Digits as their run lengths, letters as A or a, separators as they are."""
    out = re.sub(r"\d+", lambda m: str(len(m[0])), text)
    return re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", out))


def candidates(text: str) -> list[Span]:
    """(start, end, kinds) of every proposed span; kinds is 'e', 'n', 'a' or 'pi' (a number: phone or id number)."""
    out: list[Span] = []
    if "@" in text or _AT_HINT.search(text):
        out += [(m.start(), m.end(), "e") for m in EMAIL.finditer(text)]
    for m in NUMBER.finditer(text):
        if len(m[0]) < 6:
            continue
        digits = sum(c.isdigit() for c in m[0])
        if not 6 <= digits <= 24 and not (digits >= 5 and re.match(r"[A-Z]", m[0])):
            continue
        start, end = m.span()
        if text[start] == "(" and ")" not in m[0]:
            start += 1
        variants = {(start, end)}
        if extension := EXTENSION.match(text, end):
            variants.add((start, extension.end()))
        if tail := re.search(r" [A-Z]$", text[start:end]):
            variants.add((start, start + tail.start()))
        if lead := re.match(r"[A-Z]{1,2} ", text[start:end]):
            variants.add((start + lead.end(), end))
        body = text[start:end]
        if (cut := re.search(r" (?:\(?\d{4}[\-/]\d{4}|\d{4})$", body)) and digits > 11:
            variants.add((start, start + cut.start()))
        out += [(a, b, "pi") for a, b in variants]
    out += _addresses(text)
    for m in NAME.finditer(text):
        out += [(a, b, "n") for a, b in _name_spans(text, m.start(), m.end())]
    return out


def _addresses(text: str) -> set[Span]:
    """Address spans: only where a house number stands before or after a word for a street are the patterns tried."""
    found = []
    for number in _NUMBER_FIRST.finditer(text):
        a = number.start()
        unit = _UNIT_BEFORE.search(text, max(0, a - 20), a)
        found += [ADDRESS[0].match(text, unit.start() if unit else a), ADDRESS[2].match(text, a)]
    for number in _NUMBER_LAST.finditer(text):
        a, b = max(0, number.start(1) - 80), number.end()
        if _BEHIND.search(text, a, number.start(1)):
            found += [m for k in (1, 3) for m in ADDRESS[k].finditer(text, a, min(len(text), b + 40))]
    return {span for m in found if m for span in _address_variants(text, m)}


def _address_variants(text: str, m: re.Match) -> Iterator[Span]:
    yield m.start(), m.end(), "a"
    if longer := LONGER_STREET.match(text, m.end()):
        yield m.start(), longer.end(), "a"
    body = m[0]
    while (cut := re.search(rf" [{_CAP}][\w'’\-]*$", body)) and re.search(rf" (?:de |du |des |d['’])?[{_CAP}]", body[: cut.start()]):
        body = body[: cut.start()]
        yield m.start(), m.start() + len(body), "a"
    if m[0].endswith(".") and not re.search(r"(?:St|Rd|Ln|Dr|Ct|Blvd)\.$", m[0]):
        yield m.start(), m.end() - 1, "a"


def name_tokens(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, sort) of the tokens of a stretch: i an initial, p a particle, t a title, f a closed-class word, U all capitals, x another."""
    out = []
    for t in NAME_TOKEN.finditer(text, start, end):
        word = t[0]
        low = word.rstrip(".").lower()
        if word[-1] == ".":
            sort = "i"
        elif word[0].islower() or (len(word) < 4 and word.isupper() and low in _PARTICLES):
            sort = "p"
        else:
            sort = "t" if low in TITLES else "f" if low in FUNCTION else "U" if len(word) > 1 and word.isupper() else "x"
        out.append((t.start(), t.end(), sort))
    return out


_PARTICLES = frozenset("von van de del der du da di le la".split())


def _name_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of two to NAME_TOKENS words and initials of a stretch of capitalised words, without titles and closed-class words."""
    tokens = name_tokens(text, start, end)
    for i, (a, _, first) in enumerate(tokens):
        if first in "ptf":
            continue
        words = full = 0
        for _, b, sort in tokens[i : i + 2 * NAME_TOKENS]:
            if sort in "tf":
                break
            if sort == "p":
                continue
            words += 1
            full += sort != "i"
            if words > NAME_TOKENS:
                break
            if words > 1 and full:
                yield a, b


_KINDS = {"e": ("email",), "n": ("name",), "a": ("address",), "pi": ("phone", "id_number")}


_OUT_LEFT = re.compile(r"(?:([^\W\d_]+\.?|[^\w\s\[\]'\"(*]|\d)[\s\[\]'\"(*]*)?(?<![^\W\d_])([^\W\d_]+\.?|[^\w\s\[\]'\"(*]|\d)[\s\[\]'\"(*]*$")
_OUT_RIGHT = re.compile(r"[\s\[\]'\")*]*([^\W\d_]+|[^\w\s\[\]'\")*]|\d)(?:[\s\[\]'\")*]*([^\W\d_]+|[^\w\s\[\]'\")*]|\d))?")


def _outside(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """The nearest words or signs to the left and right of a span on its line, and then the second ones, past quotes, brackets
    and link marks; digits as 0."""
    left = _OUT_LEFT.search(text[max(0, start - 24) : start].rpartition("\n")[2])
    right = _OUT_RIGHT.match(text[end : end + 24].partition("\n")[0])
    sides = [left[2] if left else "", right[1] if right else "", (left[1] or "") if left else "", (right[2] or "") if right else ""]
    return tuple("0" if s.isdigit() else s for s in sides)


def _name_features(text: str, start: int, end: int, body: str, rivals: tuple[bool, bool]) -> list[str]:
    """Features of a name: its order of words, initials and particles, and the nearest words past quotes and brackets."""
    tokens = name_tokens(text, start, end)
    words = [text[a:b].rstrip(".").lower() for a, b, _ in tokens]
    order = "".join(sort for _, _, sort in tokens) + ("c" if ", " in body else "")
    outside = _outside(text, start, end)
    before, after, before2, after2 = (x.lower() for x in outside)
    loud = [x.isupper() for x in outside[:2]]
    return [
        "bias",
        f"order={order}", f"n={len(tokens)}", f"first={words[0]}", f"last={words[-1]}", f"lcap={rivals[0]}", f"rcap={rivals[1]}", f"whole={rivals}",
        f"lw={before}", f"rw={after}", f"lw rw={before} {after}", f"rend={after[-2:]}", f"rends={after[-3:]}", f"comma={', ' in body} {rivals}",
        f"lw2={before2}", f"lw12={before2} {before}", f"glue={text[start - 1 : start]}{text[end : end + 1]}",
        f"left_title={before.rstrip('.') in TITLES}", f"upper={order.count('U')} of {len(order)}", f"particle={[w for w, t in zip(words, tokens) if t[2] == 'p'][:1]} {before}",
        f"article={before in ARTICLES} {'p' in order}", f"function={before in FUNCTION} {after in FUNCTION}",
        f"short={min(len(words[0]), 3)}", f"alone={before[:1] in ' =|' and not after}", f"lower={before[:1].islower()} {after[:1].islower()}",
        f"rw2={after if not after[:1].isalpha() else ''} {after2}", f"loud={loud} {order.count('U') > 1}", f"street={words[0] in STREET_WORDS} {words[-1] in STREET_WORDS}",
    ]


def features(text: str, span: Span, rivals: tuple[bool, bool]) -> list[str]:
    """Names of the features of a whole span.

    rivals: whether a longer, a shorter candidate of its kind overlaps it; of a name, whether the stretch of capitalised
    words goes on to its left, to its right.
    """
    start, end, kinds = span
    body = text[start:end]
    if kinds == "n":
        return _name_features(text, start, end, body, rivals)
    left = [w.lower() for w in _LEFT.findall(text[max(0, start - 45) : start].rpartition("\n")[2])][-4:]
    right = [w.lower() for w in _LEFT.findall(text[end : end + 25].partition("\n")[0])][:2]
    left = ["0" if w.isdigit() else w for w in left]
    right = ["0" if w.isdigit() else w for w in right]
    out = ["bias", f"l1={left[-1] if left else '^'}", f"r1={right[0] if right else '$'}", f"longer={rivals[0]}", f"shorter={rivals[1]}"]
    if len(left) > 1:
        out.append(f"l2={left[-2]}")
        out.append(f"l12={left[-2]} {left[-1]}")
    out += [f"near={w}" for w in left[:-1] if w[0].isalpha()]
    if start and not text[start - 1].isspace():
        out.append(f"glued={text[start - 1]}")
    if kinds == "pi":
        digits = [c for c in body if c.isdigit()]
        letters = sum(c.isalpha() for c in body)
        out += [f"shape={_shape(body)}", f"digits={len(digits)}", f"letters={min(letters, 3)}", f"plus={'+' in body}", f"paren={'(' in body}", f"seps={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', body))))}"]
        out.append(f"zero={body.lstrip('(+')[:1] == '0'}")
        out.append(f"ext={bool(re.search(r'[a-z]', body))}")
        out.append(f"letters={min(letters, 3)} digits={len(digits)}")
        out.append(f"dates={bool(re.match(r'(?:[(]?[12][0-9]{3}[-/][12][0-9]{3}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})', body))}")
        out.append(f"ip={bool(re.fullmatch(r'[0-9]{1,3}([.][0-9]{1,3}){3}', body))}")
    elif kinds == "a":
        out += [f"unit={bool(re.search(r'Unit|Flat|Apt|bajo|º', body))}", f"dot={body.endswith('.')}", f"begins={'digit' if body[0].isdigit() else 'word'}"]
        out.append(f"starter_last={body.rsplit(' ', 1)[-1].lower().rstrip('.') in STARTERS}")
        if body[0].isdigit() or body[0] in "UFASR":
            out += [f"street={bool(_ENDS_STREET.search(body))}", f"dotted={body.rsplit(' ', 1)[-1] if body.endswith('.') else ''}"]
        tail = re.search(rf"(?:(de la|de|du|des|aux|au|à la|del) )?((?:[{_CAP}][\w'’\-]+ ?)+)$", body)
        if tail:
            out.append(f"after_preposition={bool(tail[1])} capitals={len(tail[2].split())}")
        out.append(f"starter_next={bool(right) and right[0].rstrip('.:') in STARTERS}")
    else:
        out += [f"plain={'@' in body and ' ' not in body}"]
    return out


def clusters(text: str, spans: list[Span]) -> Iterator[list[Span]]:
    """Groups of candidates that overlap directly or through others, in text order."""
    held: list[Span] = []
    reach = -1
    for span in sorted(set(spans)):
        if held and span[0] >= reach:
            yield held
            held = []
        held.append(span)
        reach = max(reach, span[1]) if len(held) > 1 else span[1]
    if held:
        yield held


def _rivals(text: str, cluster: list[Span]) -> list[tuple[bool, bool]]:
    """The rivals of each span of a cluster, which is sorted; a sweep looks only at neighbours that overlap."""
    longer, shorter = [False] * len(cluster), [False] * len(cluster)
    active: list[int] = []
    for k, (start, end, kind) in enumerate(cluster):
        if kind == "n":
            longer[k], shorter[k] = bool(_GOES_LEFT.search(text, max(0, start - 40), start)), bool(_GOES_RIGHT.match(text, end))
            continue
        active = [a for a in active if cluster[a][1] > start]
        for a in active:
            if cluster[a][2] == kind:
                mine, other = end - start, cluster[a][1] - cluster[a][0]
                longer[k], shorter[k] = longer[k] or other > mine, shorter[k] or other < mine
                longer[a], shorter[a] = longer[a] or mine > other, shorter[a] or mine < other
        active.append(k)
    return list(zip(longer, shorter))


_GOES_LEFT = regex.compile(rf"(?:{_NAME_WORD}|{_INITIAL})(?:,? )(?:{_PARTICLE} )?$")
_GOES_RIGHT = regex.compile(rf"(?:,? )(?:{_PARTICLE} )?(?:{_NAME_WORD}|{_INITIAL})")


def scored(text: str, cluster: list[Span]) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, type, feature names) for every candidate and type of a sorted cluster, by end."""
    out = []
    for span, rivals in zip(cluster, _rivals(text, cluster)):
        names = features(text, span, rivals)
        out += [(span[0], span[1], kind, [f"{kind}|{n}" for n in names]) for kind in _KINDS[span[2]]]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def decode(items: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[Span]:
    """The disjoint typed spans of the highest total score."""
    ends = [x[1] for x in items]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # after the first k items: score, items before the chosen one, chosen
    for k, (start, _, _, names) in enumerate(items):
        before = bisect_right(ends, start, 0, k)
        score = best[before][0] + sum([weights.get(n, 0.0) for n in names])
        best.append((score, before, True) if score > best[k][0] else (best[k][0], k, False))
    out, k = [], len(items)
    while k:
        _, before, chosen = best[k]
        if chosen:
            out.append(items[k - 1][:3])
        k = before
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    high, low = max(a, b), min(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _expected(items: list[tuple], scores: list[float]) -> list[float]:
    """The probability of each item under the model, by the forward and backward sums over all segmentations."""
    n = len(items)
    ends = [x[1] for x in items]
    before = [bisect_right(ends, items[k][0], 0, k) for k in range(n)]
    forward = [0.0] * (n + 1)
    for k in range(n):
        forward[k + 1] = _log_add(forward[k], forward[before[k]] + scores[k])
    backward = [-math.inf] * n + [0.0]
    for k in range(n - 1, -1, -1):
        backward[k] = _log_add(backward[k], backward[k + 1])
        backward[before[k]] = _log_add(backward[before[k]], backward[k + 1] + scores[k])
    return [math.exp(forward[before[k]] + scores[k] + backward[k + 1] - forward[n]) for k in range(n)]


@cache
def fitted_weights(rounds: int = 24, rate: float = 0.3, decay: float = 0.002) -> dict[str, float]:
    """The weights, fitted to the annotated sentences (a fixed, bounded sample)."""
    number: dict[str, int] = {}
    lattices = []
    for text, gold in pii_training.examples():
        truth = set(gold)
        for cluster in clusters(text, candidates(text)):
            items = scored(text, cluster)
            coded = [[number.setdefault(n, len(number)) for n in x[3]] for x in items]
            lattices.append((items, coded, [1.0 if x[:3] in truth else 0.0 for x in items]))
    weights = [0.0] * len(number)
    order = random.Random(1)
    for k in range(rounds):
        step = rate / (1 + k / 8)
        order.shuffle(lattices)
        for items, coded, truth in lattices:
            scores = [sum([weights[n] for n in ids]) for ids in coded]
            for ids, want, is_now in zip(coded, truth, _expected(items, scores)):
                error = want - is_now
                if abs(error) > 2e-3:
                    for n in ids:
                        weights[n] += step * (error - decay * weights[n])
    return {n: weights[k] for n, k in number.items() if abs(weights[k]) > 1e-3}


def find_in_text(text: str | None, weights: dict[str, float]) -> list[Span]:
    """The typed spans of a text, in order; none for a null or empty text."""
    if not text:
        return []
    return [s for cluster in clusters(text, candidates(text)) for s in decode(scored(text, cluster), weights)]


def _finder(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            ids, kinds, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, end, kind in find_in_text(text, table):
                    ids.append(doc_id)
                    kinds.append(kind)
                    texts.append(text[start:end])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "kind", "found_text"]
            )

    return run


def find_personal(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Distinct (doc_id, kind, found_text) of the personal information in every document.

    Null and empty texts give no rows; repeated documents with one id count once; extra columns are ignored.
    """
    weights = documents.sparkSession.sparkContext.broadcast(fitted_weights())
    found = documents.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(_finder(weights), "doc_id bigint, kind string, found_text string")
    return found.distinct()


def redact_text(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with each found span replaced by [KIND]; the rest is unchanged."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in find_in_text(text, weights):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_personal(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with typed placeholders in place of personal information; null stays null, other columns stay."""
    weights = documents.sparkSession.sparkContext.broadcast(fitted_weights())
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([redact_text(t, weights.value) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, text, clean)

    return documents.mapInArrow(run, documents.schema)
