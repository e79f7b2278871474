"""Problem 9: personal information inside free text, by a semi-Markov conditional random field.

Patterns propose candidate segments of each type. A log-linear model scores whole segments from features of their form,
words, lexicon entries and neighbourhood, and neighbouring segments from their types. Dynamic programming over the
candidates finds the best non-overlapping choice of boundaries and types; what no chosen segment covers is plain text.
The weights are fitted by gradient ascent on the conditional likelihood of labelled texts, on the driver, and broadcast.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read
from .personal_labels import labelled
from .quality import FUNCTION_WORDS

NEAR = 40
"""Characters within which the types of neighbouring mentions are scored together."""
LOOK_BACK = 12
"""Candidates that end shortly before one and are tried as its neighbour."""
EPOCHS, RATE, DECAY = 14, 0.25, 1e-4

_W = r"[ \t]*\n?[ \t]*"
_STREET = r"(?:(?:Street|Road|Avenue|Lane|Close|Terrace|Drive|Way|Square|Court|Crescent|Boulevard|Place|STREET|ROAD|AVENUE|LANE|CLOSE|TERRACE|DRIVE|WAY|Rd|RD)\b|(?:St|Ave|Blvd|ST|AVE)\b\.?)"
_CAP = r"[A-ZÀ-Ý][\wà-ÿ'’-]*"
_AT = re.compile(r"@|\s?[(\[{](?:at|AT)[)\]}]\s?|(?<=\w)\s+(?:at|AT)\s+(?=[\w-]+(?:\s+(?:dot|DOT)\s))")
_USER = re.compile(r"[A-Za-z0-9][\w.+-]*\Z")
_HOST = re.compile(r"[A-Za-z0-9][\w-]*(?:(?:\.|\s?[(\[{](?:dot|DOT)[)\]}]\s?|\s+(?:dot|DOT)\s+)[A-Za-z0-9][\w-]*)+")
CANDIDATES = (
    ("phone", re.compile(r"(?<![\w.,@#/$+(-])(?:\+\d|\(\d{2,5}\)|\d)(?:[ .\-/()]{0,2}\d){5,14}(?![\w@])(?![-/.]\d)(?:,?\s?(?:ext\.?|x)\s?\d{1,5})?")),
    ("phone", re.compile(r"(?<=\()(?:\+?\d|\(\d{2,5}\))(?:[ .\-/()]{0,2}\d){5,14}(?![\w@])(?![-/.]\d)")),
    ("id_number", re.compile(r"(?<![\w.,@#/$+-])(?:\d{3}([- ])\d{2}\1\d{4}(?![\w-])|\d{3}[ ]\d{3}[ ]\d{3}(?![\w-])|\d{8}-?[A-Z](?!\w))")),
    ("id_number", re.compile(r"\b[A-Z](?:[A-Z][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]|\d{7,8}|[A-Z]\d{6,9}|\d{2}[A-Z]\d{4,6})(?![\w-])")),
    ("address", re.compile(rf"(?:\b(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|FLAT|APT){_W}\w{{1,5}},{_W})?(?<![\w.,/-])\d{{1,5}}[A-Za-z]?,?{_W}{_CAP}{_W}(?:{_CAP}{_W})?{_STREET}")),
    ("address", re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:{_W}(?:bis|ter))?,?{_W}(?:rue|avenue|boulevard|impasse|place|chemin|allée|quai|cours|route|RUE|AVENUE|BOULEVARD|IMPASSE|PLACE){_W}(?:(?:de{_W}la|du|des|de{_W}l['’]|de|d['’]|DE{_W}LA|DU|DES){_W})?{_CAP}")),
    ("address", re.compile(rf"\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|STRASSE|STRAßE|WEG|GASSE|ALLEE|PLATZ){_W}\d{{1,4}}[a-z]?\b")),
    ("address", re.compile(rf"\b(?:Calle|Plaza|Avenida|Paseo|Camino|Ronda|CALLE|PLAZA|AVENIDA){_W}(?:(?:de{_W}la|del|de{_W}los|de{_W}las|de|DE{_W}LA|DEL){_W})?{_CAP}{_W},?{_W}\d{{1,4}}\b")),
)
_NAME = re.compile(r"[A-ZÀ-Ý](?<![\w@.+-][\s\S])(?:(?:[a-zà-ÿ]+|[A-ZÀ-Ý]+)(?:-(?:[A-ZÀ-Ý][a-zà-ÿ]+|[A-ZÀ-Ý]{2,}))*(?![\w@])|\.(?=\s))")
_GAP = re.compile(r"[ \t]*\n?[ \t]*\Z")
_COMMA = re.compile(r",[ \t]*\n?[ \t]*\Z")
#: For each pattern of CANDIDATES: something cheap that a text must hold for it to be tried, a pattern or any of some words.
_NEEDS = (
    re.compile(r"\d(?:[ .\-/()]{0,2}\d){5}"),
    ("(+", "((", *(f"({d}" for d in range(10))),
    re.compile(r"\d(?:\d\d[- ]\d\d|\d{7})"),
    re.compile(r"[A-Z](?: ?\d{2} ?\d{2} ?\d{2}|\d{2}[A-Z]\d{4})"),
    ("Street", "Road", "Avenue", "Lane", "Close", "Terrace", "Drive", "Way", "Square", "Court", "Crescent", "Boulevard", "Place", "STREET", "ROAD", "AVENUE", "LANE", "CLOSE", "TERRACE", "DRIVE", "WAY", "Rd", "RD", "St", "Ave", "Blvd", "ST", "AVE"),
    ("rue", "avenue", "boulevard", "impasse", "place", "chemin", "allée", "quai", "cours", "route", "RUE", "AVENUE", "BOULEVARD", "IMPASSE", "PLACE"),
    ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "STRASSE", "STRAßE", "WEG", "GASSE", "ALLEE", "PLATZ"),
    ("Calle", "Plaza", "Avenida", "Paseo", "Camino", "Ronda", "CALLE", "PLAZA", "AVENIDA"),
)
_AT_NEEDS = ("@", "(at", "[at", "{at", "(AT", "[AT", "{AT", " dot", " DOT", "\ndot", "\nDOT")


def _holds(text: str, need: tuple | re.Pattern) -> bool:
    return any(w in text for w in need) if isinstance(need, tuple) else need.search(text) is not None


_WORD_BEFORE = re.compile(r"[^\W_]+|\n")
_NEXT_WORD = re.compile(r"[^\S\n]*([^\W_]+|\n)?")
_DIGITS = re.compile(r"\d")
_GROUPS = re.compile(r"\d+")
_EXTENSION = re.compile(r",?\s?(?:ext\.?|x)\s?\d{1,5}\Z")
#: Words that tell what a number or name beside them is, in the languages of the data.
CUES = {
    "phone": "tel telephone phone phones ring call calls called calling dial mobile cell cellphone fax text sms hotline switchboard telefon fon anruf anrufen rufnummer handy mobil tél téléphone telephone appelez appeler portable joint joindre teléfono tfno llame llamar móvil",
    "id": "ssn social security insurance passport passports identity id ni national dni nie reisepass ausweis personalausweis ausweisnummer passeport identité pasaporte identidad papers",
    "code": "order orders part parts invoice tracking track isbn issn grid square reference ref version release build serial model item batch catalogue lot account parcel shipment ticket case article chapter page room sku code rechnung bestellung bestellnummer artikelnummer artikel facture commande pedido factura referencia mark marks number numbers coordinates",
    "title": "mr mrs ms miss dr prof sir dame captain herr frau madame monsieur mme mlle señor señora sr sra don doña",
    "address": "address at in lives live lived office house home street visit deliver anschrift adresse wohnt siège domicilio dirección",
    "firm": "ltd inc llc plc gmbh ag company co partners brothers sons museum society bridge station hall school college church park hotel press books studio university club bros associates group",
    "way": "street road lane avenue drive close terrace square court crescent boulevard place way st rd ave",
    "day": "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun daily o clock am pm",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
BACK = 4
"""Words before a segment in which a cue is looked for, on its own line and the one before."""


def _holds_cue(words: list[str]) -> str:
    return next((_CUE[w] for w in words if w in _CUE), "")


class Lexicon:
    """Known given and family names and the endings that family names take."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = {g.lower() for g in given}, {f.lower() for f in family}
        ends = Counter(f[-n:] for f in self.family for n in (3, 4) if len(f) > n + 1)
        self.ends = {e for e, c in ends.items() if c >= max(2, 0.01 * len(self.family))}

    def family_ends(self) -> list[str]:
        """Its endings in a fixed order."""
        return sorted(self.ends)

    def ending(self, name: str) -> bool:
        """Whether a name ends like family names do."""
        low = name.lower()
        return low[-3:] in self.ends or low[-4:] in self.ends


def _word_class(word: str) -> str:
    """A word as the model sees it: a cue class, a function word as it is, else its shape. Names and topics are never seen."""
    low = word.lower()
    if low in _CUE:
        return _CUE[low]
    if low in FUNCTION_WORDS:
        return low
    if word == "\n":
        return "nl"
    return "num" if word.isdigit() else "cap" if word[:1].isupper() else "low"


def _context(text: str, a: int, b: int) -> list[str]:
    before = text[max(0, a - 60) : a]
    words = _WORD_BEFORE.findall(before)[-BACK:]
    prev = _word_class(words[-1]) if words else "^"
    cue = _holds_cue([w.lower() for w in reversed(words)])
    m = _NEXT_WORD.match(text, b)
    follow = _word_class(m.group(1)) if m and m.group(1) else "$" if b >= len(text) else "w"
    sign = before.rstrip(" \t")[-1:] or "^"
    sign = "w" if sign.isalnum() else "nl" if sign == "\n" else sign
    after = text[b : b + 1]
    after = "w" if after.isalnum() else "nl" if after == "\n" else after or "$"
    alone = sign in ("^", "nl") and after in ("$", "nl")
    return [f"p={prev}", f"cue={cue}", f"n={follow}", f"c={sign}", f"d={after}", f"alone={alone:d}"]


def _shout(text: str, a: int, b: int) -> str:
    """Which of the words beside a segment in capitals are in capitals too."""
    before, after = _WORD_BEFORE.findall(text[max(0, a - 30) : a]), _NEXT_WORD.match(text, b)
    return "".join("y" if w and len(w) > 1 and w.isupper() else "n" for w in (before[-1] if before else "", after.group(1) if after else ""))


def _number_form(kind: str, raw: str) -> list[str]:
    """Whole-span features of a number, without its extension: its shape, groups, marks and beginning."""
    raw = _EXTENSION.sub("", raw)
    groups = [len(g) for g in _GROUPS.findall(raw)]
    marks = "".join(sorted({c for c in raw if not c.isalnum()}))
    shape = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", raw)).replace(" ", "_")
    begin = "+" if raw[0] == "+" else "(" if raw[0] == "(" else "0" if raw[0] == "0" else "A" if raw[0].isalpha() else "9"
    return [f"{kind}:{shape}", f"{kind}#{sum(groups)}", f"{kind}g{len(groups)}", f"{kind}b{begin}", f"{kind}m{marks}", f"{kind}l{groups[-1] if groups else 0}", f"{kind}f{groups[0] if groups else 0}{begin}", f"{kind}b{begin}m{marks}#{sum(groups)}"]


def _emails(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _AT.finditer(text) if _holds(text, _AT_NEEDS) else ():
        user, host = _USER.search(text[max(0, m.start() - 80) : m.start()]), _HOST.match(text, m.end())
        if user and host:
            out.append((m.start() - len(user.group()), host.end()))
    return out


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, type, features) of all candidate segments, by end."""
    found: dict[tuple[int, int, str], list[str]] = {}
    digits = _DIGITS.search(text) is not None
    for a, b in _emails(text):
        raw = text[a:b]
        found[a, b, "email"] = ["t=email", f"e@{'@' in raw}", f"edot{raw.lower().count('dot')}", f"edots{min(raw.count('.'), 3)}"] + [f"e{c}" for c in _context(text, a, b)]
    for k, (kind, pattern) in enumerate(CANDIDATES if digits else ()):
        if not _holds(text, _NEEDS[k]):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            raw = m.group()
            key = (a, b, kind)
            if key in found:
                continue
            f = [f"t={kind}", f"k={k}"] + [f"{kind[0]}{c}" for c in _context(text, a, b)]
            if kind == "address":
                f += [f"alast={raw.split()[-1].lower() if raw[0].isdigit() and k == 4 else k}", f"afn={any(w.lower() in FUNCTION_WORDS for w in raw.split()[1:-1])}", f"acase={raw.split()[-1][:1].isupper()}", f"anum={min(sum(map(str.isdigit, raw)), 5)}"]
            else:
                f += _number_form(kind, raw)
            found[key] = f
    tokens = [(m.start(), m.end(), m.group()) for m in _NAME.finditer(text)]
    for i in range(len(tokens) - 1):
        for n in (2, 3):
            if i + n > len(tokens):
                break
            part = tokens[i : i + n]
            gaps = [text[part[j][1] : part[j + 1][0]] for j in range(n - 1)]
            if not all(len(g) <= 6 and (_GAP.match(g) or (n == 2 and _COMMA.match(g))) and g for g in gaps):
                break
            comma = "," in gaps[0]
            initials = [p[2].endswith(".") for p in part]
            if n == 3 and not initials[1]:
                break
            if initials[0] and comma or initials[-1] and not comma:
                continue
            given, family = (part[-1][2], part[0][2]) if comma else (part[0][2], part[-1][2])
            heads = family.split("-")
            known = any(h.lower() in lexicon.family for h in heads)
            ending = any(map(lexicon.ending, heads))
            first = given.endswith(".") or given.lower() in lexicon.given
            if not (known or ending or given.lower() in lexicon.given):
                continue
            a, b = part[0][0], part[-1][1]
            form = ("c" if comma else "") + "".join("i" if x else "w" for x in initials)
            plain = given.lower() in FUNCTION_WORDS or family.lower() in FUNCTION_WORDS
            f = ["t=person", f"form={form}", f"lex={first:d}{known:d}{ending:d}", f"lex={first:d}{known:d}{ending:d}{form}", f"nl={any(chr(10) in g for g in gaps)}", f"up={part[0][2].isupper() and len(part[0][2]) > 2:d}{part[-1][2].isupper():d}"]
            f += [f"gc={_word_class(given)}", f"fc={_word_class(family)}", f"fe={'' if known else family.lower()[-3:]}", f"gl={'' if first else given.lower()[-1:]}", f"fl={0 if known else min(len(family), 9)}", f"f4={known or family.lower()[-4:] in lexicon.ends:d}", f"shout={_shout(text, a, b)}" if family.isupper() else "calm", f"gend={lexicon.ending(given):d}{given.lower() in lexicon.family:d}", f"fgiven={family.lower() in lexicon.given:d}", f"fn={plain}", f"hy={'-' in family:d}{'-' in given:d}"]
            f += [f"P{c}" for c in _context(text, a, b)]
            found.setdefault((a, b, "person"), f)
    return sorted(((a, b, t, f) for (a, b, t), f in found.items()), key=lambda c: (c[1], c[0]))


def _links(spans: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, list[int]]]:
    """For each candidate: the nearby ones that end at or before its start, and how many end before these.

    A segmentation's last choice before a candidate is one of the nearby ones, whose pair with it is scored, or among the
    first so many, whose pair is not.
    """
    ends = [c[1] for c in spans]
    out = []
    for a, _, _, _ in spans:
        k = bisect_right(ends, a)
        near = [j for j in range(max(0, k - LOOK_BACK), k) if a - ends[j] <= NEAR]
        out.append((k - len(near), near))
    return out


def _pair(x: str, y: str) -> str:
    return f"{x}>{y}"


def segment(spans: list, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best choice of non-overlapping candidates."""
    n = len(spans)
    if not n:
        return []
    score = [sum(weights.get(f, 0.0) for f in c[3]) for c in spans]
    links = _links(spans)
    top = [0.0] * (n + 1)  # best over the first k candidates
    last = [-1] * (n + 1)  # the last chosen one in it
    best, back = [0.0] * n, [-1] * n
    for i in range(n):
        first, near = links[i]
        value, frm = top[first], last[first]
        for j in near:
            v = best[j] + weights.get(_pair(spans[j][2], spans[i][2]), 0.0)
            if v > value:
                value, frm = v, j
        best[i], back[i] = score[i] + value, frm
        if best[i] > top[i]:
            top[i + 1], last[i + 1] = best[i], i
        else:
            top[i + 1], last[i + 1] = top[i], last[i]
    out, i = [], last[n]
    while i >= 0:
        out.append(spans[i][:3])
        i = back[i]
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values))


def _expected(spans: list, links: list, weights: dict[str, float]) -> tuple[list[float], list[tuple[int, int, float]], float]:
    """Probability of each candidate, and of each nearby pair being neighbours, under the model, and its log partition sum."""
    n = len(spans)
    score = [sum(weights.get(f, 0.0) for f in c[3]) for c in spans]
    alpha, total = [0.0] * n, [0.0] * (n + 1)  # paths that end with a candidate; all paths over the first k
    paths: list[list[float]] = []
    for i in range(n):
        first, near = links[i]
        into = [total[first], *(alpha[j] + weights.get(_pair(spans[j][2], spans[i][2]), 0.0) for j in near)]
        paths.append(into)
        alpha[i] = score[i] + _log_sum(into)
        total[i + 1] = _log_sum([total[i], alpha[i]])
    d_total, d_alpha = [0.0] * (n + 1), [0.0] * n  # derivatives of the log partition sum
    d_total[n] = 1.0
    pairs = []
    for i in range(n - 1, -1, -1):
        p = math.exp(alpha[i] - total[i + 1])
        d_alpha[i] += d_total[i + 1] * p
        d_total[i] += d_total[i + 1] * (1 - p)
        first, near = links[i]
        inner = alpha[i] - score[i]
        d_total[first] += d_alpha[i] * math.exp(paths[i][0] - inner)
        for j, v in zip(near, paths[i][1:]):
            share = d_alpha[i] * math.exp(v - inner)
            d_alpha[j] += share
            pairs.append((j, i, share))
    return d_alpha, pairs, total[n]


def train(texts: list, lexicon: Lexicon) -> dict[str, float]:
    """Weights that maximise the conditional likelihood of the labelled segmentations, less an L2 penalty, by AdaGrad."""
    data = []
    for text, marks in texts:
        spans = candidates(text, lexicon)
        truth = {(a, b, t) for a, b, t in marks}
        starts = {(a, t) for a, _, t in marks}
        gold = []
        for i, c in enumerate(spans):
            if c[:3] in truth or ((c[0], c[2]) in starts and not any(d[:3] in truth and d[0] == c[0] and d[2] == c[2] for d in spans)):
                if not gold or spans[gold[-1]][1] <= c[0]:
                    gold.append(i)
        data.append((spans, _links(spans), gold))
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(EPOCHS):
        for spans, links, gold in data:
            if not spans:
                continue
            p, pairs, _ = _expected(spans, links, weights)
            grad: dict[str, float] = {}
            chosen = set(gold)
            for i, c in enumerate(spans):
                g = (i in chosen) - p[i]
                if abs(g) > 1e-4:
                    for f in c[3]:
                        grad[f] = grad.get(f, 0.0) + g
            for x, y in zip(gold, gold[1:]):
                if x in links[y][1]:
                    k = _pair(spans[x][2], spans[y][2])
                    grad[k] = grad.get(k, 0.0) + 1.0
            for j, i, share in pairs:
                k = _pair(spans[j][2], spans[i][2])
                grad[k] = grad.get(k, 0.0) - share
            for f, g in grad.items():
                g -= DECAY * weights.get(f, 0.0)
                seen[f] = seen.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + RATE * g / math.sqrt(seen[f] + 1e-8)
    return weights


def lexicon_of(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The fixed table ``name_lexicon`` (a few hundred rows)."""
    rows = read(spark, sf_dir, "name_lexicon").select("name", "name_kind").filter("name is not null").collect()
    return Lexicon({r[0] for r in rows if r[1] == "given"}, {r[0] for r in rows if r[1] == "family"})


def fitted(lexicon: Lexicon) -> dict[str, float]:
    """Weights trained on the labelled texts, whose family names take the lexicon's endings; once a process for the same ones."""
    return _fitted(tuple(lexicon.family_ends()))


@lru_cache(maxsize=4)
def _fitted(ends: tuple[str, ...]) -> dict[str, float]:
    texts, given, family = labelled(list(ends))
    known = Lexicon(given, family)
    known.ends = set(ends)
    return train(texts, known)


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}


def redact(text: str, mentions: list[tuple[int, int, str]]) -> str:
    """The text with each mention replaced by its kind's placeholder."""
    out, at = [], 0
    for a, b, t in mentions:
        out += [text[at:a], PLACEHOLDERS[t]]
        at = b
    return "".join(out) + text[at:]


def mentions(documents: DataFrame, lexicon: Lexicon, weights: dict[str, float]) -> DataFrame:
    """(doc_id, found, redacted) per row of ``documents`` (doc_id, text): mentions in order and the text without them.

    ``found`` holds (kind, start_pos, end_pos), positions in code points from 1. Both are null for a null text; an empty
    text has no mentions.
    """
    held = documents.sparkSession.sparkContext.broadcast((lexicon, weights))

    def run(c: dict[str, list]) -> dict[str, list]:
        lex, w = held.value
        found: list = []
        clean: list = []
        for text in c["text"]:
            got = None if text is None else segment(candidates(text, lex), w)
            found.append(None if got is None else [{"kind": t, "start_pos": a + 1, "end_pos": b} for a, b, t in got])
            clean.append(None if got is None else redact(text, got))
        return {"doc_id": c["doc_id"], "found": found, "redacted": clean}

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id bigint, found array<struct<kind:string,start_pos:int,end_pos:int>>, redacted string")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = lexicon_of(spark, sf_dir)
    return mentions(read(spark, sf_dir, "documents"), lexicon, fitted(lexicon))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of personal data with its kind and place."""
    return _mentions(spark, sf_dir).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.kind", "m.start_pos").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typed placeholders and their number of mentions."""
    return _mentions(spark, sf_dir).select("doc_id", F.size("found").alias("mentions"), "redacted")
