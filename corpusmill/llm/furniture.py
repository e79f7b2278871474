"""Problem 4: page boilerplate mixed with main content.

A page is a sequence of flat text blocks (its non-blank lines). Each block has a word count, a link density (in flat
text: the share of it that is link labels or stands in link-like segments), cue phrases, words of notices and appeals, its
form, its place in a side list, and the same of its neighbours. A decision tree trained on the labelled table in
``furniture_labels`` classifies it; it is fitted once on the driver and broadcast.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read
from .furniture_labels import MAX_ROWS, pages
from .quality import FUNCTION_WORDS
from .trees import Tree

DEPTH, LEAST = 10, 3.0
PLACES = 6
"""Places in a side list that are told apart: entries further down count as the last one."""
#: Words that label links of menus.
LABELS = frozenset(
    "home about us contact help faq privacy terms sitemap blog news shop cart search log in out login logout register my account jobs careers press team support forum gallery videos podcasts members "
    "donate prices events recipes archive archives catalogue imprint policy of service menu navigation categories store products services sport weather travel returns shipping".split()
)
#: Words of notices and appeals to the reader of a page, by purpose.
NOTICE = frozenset("cookie cookies javascript browser device consent privacy tracking preferences settings accept website site data partners policy terms experience enable disabled personalised content external".split())
APPEAL = frozenset("subscribe newsletter sign join email inbox member members membership account free register log login donate support follow updates readers".split())
BAR = frozenset("share tweet print like comment comments reply tags tagged posted filed shares views permalink older newer next previous prev page load more top".split())
READER = frozenset("you your we our us".split())
PAST = frozenset("was were had did came went said told saw took made left stood".split())
#: Cue phrases by purpose, matched at the start of a block without its marks, or anywhere in it.
START_CUES = (
    r"skip |jump to|go to (?:main|content)|toggle |(?:open|close|main|site) (?:menu|navigation)|menu$|search(?: for| this)?\b.{0,14}$|back to|to top",
    r"(?:notice: ?)?(?:(?:we|this (?:web)?site|our (?:web)?site|our pages|the site)\b.{0,24}\b(?:use|uses|set|sets|store|stores|rely|relies|need|needs|value|require|requires)\b|(?:by|if you) (?:using|continuing|browsing|visiting|scrolling|clicking|closing|staying|continue)|please (?:enable|turn on|update|accept|activate)|(?:enable|accept) |javascript|your (?:browser|privacy)|this page (?:requires|needs)|cookies? (?:help|settings|policy|notice))",
    r"subscribe|sign (?:up|in)|log in to|register$|create an? |enter your|join |get (?:our|the|new|weekly|all)\b|become a|never miss|don.t miss|stay (?:up|in|tuned|informed)|support (?:us|our)|download our|continue reading",
    r"share\b|tweet|print(?: this)?(?: page| article| story| recipe| thread)?(?:$|\s{2}|\s*[|·•/])|e-?mail\b.{0,20}$|send (?:this|to)|tags?:|tagged|posted|filed under|permalink|\d+ (?:comments?|shares|likes|views)|no comments|comments?\b.{0,12}$|(?:leave|add|write) a|reply$|report this|like this",
    r"[«‹←]|older\b.{0,8}$|newer\b.{0,8}$|(?:next|previous|prev)\b(?:.{0,10}$|:| (?:article|page|post|thread|story))|(?:load|show|view|see) (?:more|all)|read more\b.{0,3}$|page \d+ of",
    r"ads?$|advert|sponsor|promoted|(?:story|article|text) continues|.{0,20}continues? (?:below|after)|(?:click|tap|touch) ",
    r"©|\(c\) \d|copyright|all (?:rights|content)|powered by|designed by|built (?:by|with)|theme by|imprint\b|legal notice|site map|terms of|privacy(?: policy| notice| choices| and |$)|read (?:the|our) (?:privacy|terms|policy)|photo credits?:|last updated",
    r"(?:read|watch) also|also read|related:|see also:|more:|follow (?:us|me)|find us",
)
ANY_CUES = r"cookie|javascript|newsletter|all rights reserved|permalink|on your device|in your browser|privacy policy|terms of (?:service|use)|your data|consent|our partners|your inbox|not responsible for|external (?:links|sites|content)|join .{0,20}\b(?:readers|members)|read also"
HEADS = r"(?:related|recent|latest|popular|recommended|similar|new|top|other) (?:posts?|articles?|stories|news|comments|recipes|reading|pages?|topics)$|related$|(?:most|editor.s) (?:read|popular|viewed|shared|picks)$|trending(?: now| today)?$|popular (?:this|right|now|on).{0,10}$|recommended for you$|(?:you|customers) (?:may|might|also)\b.{0,20}(?:like|bought|enjoy)$|more (?:from|stories|news|on)\b.{0,40}$|categories$|archives?$|new on\b.{0,20}$|latest$"

_START = re.compile("|".join(f"({c})" for c in START_CUES), re.I)
_ANY, _HEAD = re.compile(ANY_CUES, re.I), re.compile(HEADS, re.I)
_MARKS = re.compile(r"<[^<>]*>|^[\s#*\[(=>~`'_-]+|[\s\]=*`'_×~]+$")
_SPLIT = re.compile(r"\s+(?:[|·•»›/→>—-]|::)\s+|\s*\t\s*|\s{2,}")
_WORDS = re.compile(r"[^\W_]+")
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]*$")
_FORM = re.compile(r"\s*(?:[-*•+›]\s|\(?\d{1,3}[.)]\s|[|!{}<\\$]|=+[^=]|\d{4}-\d\d-\d\d|~~~|```)")
_SIGNS = re.compile(r"[\[\]{}()=;<>\\$_]")
_COUNT = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)? \(\d+\)$")

OWN = 24
FEATURES = OWN + 11


def _block(line: str) -> list[float]:
    bare = _MARKS.sub("", line).strip()
    words = _WORDS.findall(bare.lower())
    parts = [p for p in _SPLIT.split(bare) if p]
    n = len(words)
    labels = sum(w in LABELS for w in words) / n if n else 0.0
    links = sum(len(p.split()) <= 3 for p in parts) / len(parts) if len(parts) > 1 else 0.0
    start = _START.match(bare)
    cue = start.lastindex if start else 0
    any_cue, head = bool(_ANY.search(bare)), bool(_HEAD.match(bare)) and n <= 8
    ends = bool(_ENDS.search(bare))
    digits = sum(w.isdigit() for w in words) / n if n else 0.0
    title = 3 <= n <= 10 and not ends and len(parts) == 1 and (bare[:1].isupper() or bare[:1].isdigit()) and not _FORM.match(line) and digits < 0.3
    count = bool(_COUNT.match(bare))
    density = max(labels, links if len(parts) > 2 else 0.0)
    small, notice, appeal, bar, reader, past = (sum(w in kind for w in words) for kind in (FUNCTION_WORDS, NOTICE, APPEAL, BAR, READER, PAST))
    return [
        n, len(bare), ends, labels, links, len(parts), density, cue, any_cue, head, title, count, bool(_FORM.match(line)), digits, small / n if n else 0.0, n > 0 and words[0] in LABELS,
        notice, appeal / n if n else 0.0, bar / n if n else 0.0, reader, past + sum(len(w) > 4 and w.endswith("ed") for w in words), (notice + appeal + bar + reader) / n if n else 0.0, cue > 0 and n <= 6, len(_SIGNS.findall(line)) / max(1, len(line)),
    ]


def features(lines: list[str]) -> tuple[list[int], np.ndarray]:
    """(line numbers from 1, features) of the non-blank lines."""
    at = [i for i, line in enumerate(lines) if line.strip()]
    own = [_block(lines[i]) for i in at]
    rows, side, titles, counts = [], 0, 0, False
    for k, b in enumerate(own):
        words, _, ends, labels, _, parts, density, cue, any_cue, head, title, count = b[:12]
        if head:
            side = 1
        elif side and (title or count) and not cue and (side == 1 or count == counts):  # all entries are titles or all counts
            side, counts = side + 1, count
        elif not (side and (cue or any_cue or density >= 0.6) and words <= 25):
            side = 0
        in_list = side > 1 and not head and (title or count)
        before, after = own[k - 1] if k else [0.0] * OWN, own[k + 1] if k + 1 < len(own) else [0.0] * OWN
        rows.append(b + [in_list, min(side, PLACES), titles, before[0], after[0], before[6], after[6], before[7] > 0, after[7] > 0, before[9], after[9]])
        titles += bool(title and not in_list and not cue)
    return [i + 1 for i in at], np.array(rows, float).reshape(len(rows), FEATURES)


@lru_cache(maxsize=1)
def model() -> Tree:
    """The tree, fitted on at most ``MAX_ROWS`` rows of the labelled table."""
    xs, ys = [], []
    for page in pages():
        xs.append(features([line for _, line in page])[1])
        ys += [float(bad) for bad, _ in page]
    return Tree(DEPTH, LEAST).fit(np.concatenate(xs)[:MAX_ROWS], np.array(ys)[:MAX_ROWS])


def classify(text: str) -> tuple[list[int], np.ndarray]:
    """(line numbers, whether furniture) of the non-blank lines of a page, by the tree of this process."""
    numbers, x = features(text.split("\n"))
    return numbers, model().predict(x) > 0.5 if len(numbers) else np.zeros(0, bool)


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(example_id, lines, body) of each row of ``pages`` (example_id, text): furniture line numbers and the main body.

    A null text has a null list and body; a blank text an empty list and an empty body. The body is the text without its
    furniture lines, blank lines at its ends removed and runs of blank lines reduced to one.
    """

    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(c: dict[str, list]) -> dict[str, list]:
        found: list = []
        bodies: list = []
        split = [t.split("\n") if t is not None else None for t in c["text"]]
        feats = [features(s) if s else None for s in split]
        some = [f[1] for f in feats if f is not None and len(f[0])]
        flags, at = held.value.predict(np.concatenate(some)) > 0.5 if some else np.zeros(0, bool), 0
        for s, f in zip(split, feats):
            if s is None:
                found.append(None)
                bodies.append(None)
                continue
            n = len(f[0])
            bad = [i for i, b in zip(f[0], flags[at : at + n]) if b]
            at += n
            drop = set(bad)
            found.append(bad)
            bodies.append(re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", "\n".join(x for i, x in enumerate(s, 1) if i not in drop)).strip("\n"))
        return {"example_id": c["example_id"], "lines": found, "body": bodies}

    return arrow_map(pages.select("example_id", "text"), run, "example_id bigint, lines array<int>, body string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each furniture line of the texts of source c4, each record once."""
    pages = read(spark, sf_dir, "example").filter("source = 'c4' and text is not null")
    rows = furniture_lines(pages).select("example_id", F.explode("lines").alias("line_no"))
    return rows.distinct()


def p4_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main body of each c4 record, with the numbers of its characters and furniture lines; each record once."""
    pages = read(spark, sf_dir, "example").filter("source = 'c4' and text is not null")
    once = furniture_lines(pages).withColumn("_h", F.xxhash64("body")).dropDuplicates(["example_id"])
    return once.select("example_id", F.size("lines").alias("furniture_lines"), F.length("body").alias("body_chars"), "body")
