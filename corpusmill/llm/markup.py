"""Problem 5: markup residue in text documents.

1. Everything that may be markup becomes a node: HTML elements (an opening with its closing tag), comments and character
   references; Markdown headings, emphasis, links, code and table rulers; wiki links, templates, headings, quote-mark
   emphasis and tables; LaTeX commands, environments and formulas. Nodes are nested by their spans.
2. Gradient-boosted trees score each node from its own form, depth, attribute names, its subtree's density, its siblings'
   kinds, places and distances, and the document's counts of kinds and families. They are fitted once, on the driver.
3. Hierarchical decoding chooses for every node, children with their parents, whether it is markup: the choice with the
   largest total score under which nothing inside an opaque node (code, formula, comment) is markup of its own.
4. Chosen nodes give the kinds of a record, and are rewritten for its clean text, in which headings of any markup become
   lines with ``#`` by level, list items begin with ``- ``, code blocks stand between lines of three backticks, and formulas
   stay between dollar signs.

Nothing has a greatest length: templates and command arguments are matched by their braces, all else up to its own end.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read
from .markup_labels import MAX_ROWS, documents
from .trees import Boosted

KINDS = ("html", "markdown", "wiki", "latex")
#: Names of HTML elements.
TAGS = frozenset(
    "a abbr article aside b blockquote body br button caption center cite code col dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img "
    "input ins label li link main meta nav ol option p pre q s script section select small span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul var video".split()
)
TYPES = (
    "tag", "element", "comment", "entity", "heading", "strong", "emphasis", "mdlink", "code", "fence", "ruler",
    "wlink", "template", "wheading", "quotes", "wtable", "wrow", "command", "environment", "formula",
)
FAMILY = dict(zip(TYPES, ["html"] * 4 + ["markdown"] * 7 + ["wiki"] * 6 + ["latex"] * 3))
OPAQUE = frozenset(("comment", "code", "fence", "formula"))

#: Attribute names that tell of markup.
ATTRIBUTES = ("href", "src", "class", "id", "style", "alt", "title", "name", "type", "width", "value", "rel", "content", "lang")

_NODE = re.compile(
    r"""(?P<comment><!--(?:[^-<]|-(?!->)|<(?!!--))*+-->|<!DOCTYPE[^<>]*+>)
    |(?P<tag></?[A-Za-z][A-Za-z0-9]*+(?:\s[^<>]*+)?/?>)
    |(?P<entity>&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)
    |^(?P<heading>\#{1,6}[ ]\S[^\n]*)$
    |^(?P<fence>(?P<_f>```|~~~)[^\n`~]*\n(?:.*?\n)?(?P=_f)[ \t]*$|(?:```|~~~)[^\n`~]*$)
    |(?P<code>`[^`\n]++`)
    |^(?P<ruler>[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?\|?[ \t]*)$
    |(?P<mdlink>!?\[[^\[\]\n]++\]\((?:[^()\s]|\([^()\s]*+\))++\))
    |(?P<wlink>\[\[[^\[\]\n]++\]\])
    |(?P<template>\{\{)
    |^(?P<wheading>(?P<_e>={2,6})[^=\n]++(?P=_e)[ \t]*)$
    |^(?P<wtable>\{\|[^\n]*|\|\}|\|-[-]*[^\n]*)
    |^(?P<wrow>![^\n]*!![^\n]*|\|[^\n|][^\n]*\|\|[^\n]*)$
    |(?P<quotes>'{2,5}(?:[^'\n]|(?<=\w)'(?=\w))++'{2,5})
    |(?P<formula>\$\$[^$]++\$\$|\$[^$\n]++\$|\\\[(?:[^\\]|\\(?![\[\]]))++\\\]|\\\((?:[^\\]|\\(?![()]))++\\\))
    |(?P<environment>\\(?:begin|end)\{[A-Za-z]++\*?\})
    |(?P<command>\\[A-Za-z]{2,}+\*?)
    |(?P<strong>(?<![\w*])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_]))
    |(?P<emphasis>(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_]))""",
    re.X | re.M | re.S,
)
_BRACE = re.compile(r"\\[\\{}]|\{\{|\}\}|[{}]")
_OPTION = re.compile(r"\[[^\[\]\n]*+\]")
_MAY = re.compile(r"[<&#*_`\[{|='$\\~]")
_INNER = re.compile(r"^(?:[#=*_`'$!~{}\[\]|\\<>/ ]+|\\[A-Za-z]+\*?\{)|[#=*_`'$~{}\[\]|<>/ ]+$")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_ATTRIBUTE = re.compile(r"\s([a-z][a-z0-9-]*)\s*=")


@dataclass
class Node:
    """A span of the text that may be markup, with the nodes inside it."""

    kind: str
    start: int
    end: int
    close: tuple[int, int] | None = None
    depth: int = 0
    children: list[Node] = field(default_factory=list)
    score: float = 0.0
    chosen: bool = False
    x: list[float] | None = None
    siblings: list[float] = field(default_factory=list)

    def all(self):
        """This node and everything inside it, in order."""
        yield self
        for c in self.children:
            yield from c.all()


class _Braces:
    """Matching braces of a text: ``single[i]`` is the place after the brace that closes the one at ``i``, ``double`` the same for pairs."""

    def __init__(self, text: str):
        self.single: dict[int, int] = {}
        self.double: dict[int, int] = {}
        if "{" not in text:
            return
        stack: list[int] = []
        pairs: list[int] = []
        for m in _BRACE.finditer(text):
            c, at = m.group(), m.start()
            if c[0] == "\\":
                continue
            if c == "{{":
                pairs.append(at)
            elif c == "}}" and pairs:
                self.double[pairs.pop()] = m.end()
            for k in range(at, m.end()):
                if text[k] == "{":
                    stack.append(k)
                elif stack:
                    self.single[stack.pop()] = k + 1


def _spans(text: str, braces: _Braces, start: int = 0, end: int | None = None) -> list[Node]:
    out: list[Node] = []
    work = [(start, len(text) if end is None else end)]
    while work:
        at, stop = work.pop()
        while m := _NODE.search(text, at, stop):
            kind = m.lastgroup if not m.lastgroup.startswith("_") else next(k for k in ("fence", "wheading") if m.group(k))
            a, b = m.span(kind)
            at = m.end()
            if kind == "template":
                b = braces.double.get(a, 0)
                if not a + 4 < b <= stop:
                    continue
                work.append((a + 2, b - 2))
                at = b
            elif kind == "command":
                first = b
                option = _OPTION.match(text, b, stop)
                b = option.end() if option else b
                while b in braces.single and braces.single[b] <= stop:
                    b = braces.single[b]
                if b > first:
                    work.append((first, b))
                at = b
            elif kind in ("heading", "strong", "emphasis", "quotes", "mdlink", "wlink", "wheading", "wrow") and b - a > 4:
                work.append((a + (2 if kind == "heading" else 1), b - 1))
            out.append(Node(kind, a, b))
            at = max(at, a + 1)
    return out


def parse(text: str) -> list[Node]:
    """The roots of the node tree of a text."""
    if not _MAY.search(text):
        return []
    nodes, open_tags, done = sorted(_spans(text, _Braces(text)), key=lambda n: n.start), [], []
    for n in nodes:
        if n.kind != "tag":
            done.append(n)
            continue
        name = _NAME.match(text, n.start).group(1).lower()
        if text[n.start + 1] != "/":
            open_tags.append((name, n))
            done.append(n)
            continue
        at = next((i for i in range(len(open_tags) - 1, max(-1, len(open_tags) - 50), -1) if open_tags[i][0] == name), None)
        if at is None:
            done.append(n)
        else:
            first = open_tags[at][1]
            del open_tags[at:]
            first.kind, first.close, first.end = "element", (n.start, n.end), n.end
            first.x = None
    done.sort(key=lambda n: (n.start, -n.end))
    roots: list[Node] = []
    stack: list[Node] = []
    for n in done:
        while stack and stack[-1].end <= n.start:
            stack.pop()
        if stack and n.end > stack[-1].end:
            stack.pop()
        n.depth = len(stack)
        (stack[-1].children if stack else roots).append(n)
        if len(stack) < 200:
            stack.append(n)
    return roots


def _place_siblings(nodes: list[Node]) -> None:
    """Statistics of each node's siblings: how many, its place among them, the share of its kind, the gaps to its neighbours."""
    n = len(nodes)
    kinds: dict[str, int] = {}
    for c in nodes:
        kinds[c.kind] = kinds.get(c.kind, 0) + 1
    for k, c in enumerate(nodes):
        before, after = nodes[k - 1] if k else None, nodes[k + 1] if k + 1 < n else None
        c.siblings = [
            math.log1p(n), k / n, kinds[c.kind] / n, math.log1p(max(0, c.start - before.end)) if before else 12.0, math.log1p(max(0, after.start - c.end)) if after else 12.0,
            before is not None and before.kind == c.kind, after is not None and after.kind == c.kind, before is not None and FAMILY[before.kind] != FAMILY[c.kind],
        ]
        _place_siblings(c.children)


def describe(text: str, roots: list[Node]) -> list[Node]:
    """All nodes with their features in ``x``."""
    _place_siblings(roots)
    nodes = [n for r in roots for n in r.all()]
    kinds: dict[str, int] = {}
    families: dict[str, int] = {}
    for n in nodes:
        kinds[n.kind] = kinds.get(n.kind, 0) + 1
        families[FAMILY[n.kind]] = families.get(FAMILY[n.kind], 0) + 1
    noise: dict[int, float] = {}
    sizes: dict[int, int] = {}
    for n in reversed(nodes):
        sizes[id(n)] = 1 + sum(sizes[id(c)] for c in n.children)
    for n in nodes:
        first = text.rfind("\n", 0, n.start) + 1
        if first not in noise:
            last = text.find("\n", n.start)
            line = text[first : last if last >= 0 else len(text)]
            noise[first] = sum(not c.isalnum() and not c.isspace() for c in line) / max(1, len(line))
        raw = text[n.start : n.end]
        inner = _INNER.sub("", raw).strip() if len(raw) < 2000 else raw
        letters = sum(map(str.isalpha, inner))
        name = _NAME.match(raw)
        tag = name is not None and name.group(1).lower() in TAGS
        known = n.kind == "entity" and (raw[1] == "#" or raw[1:] in html5)
        inside = sum(c.end - c.start for c in n.children)
        opening = raw[: raw.find(">") + 1].lower() if n.kind in ("tag", "element") else ""
        names = [m.group(1) for m in _ATTRIBUTE.finditer(opening)]
        n.x = [
            *(float(n.kind == t) for t in TYPES),
            math.log1p(len(raw)), letters / max(1, len(inner)), inner[:1].isdigit(), inner[-1:].isalnum(), len(inner.split()),
            n.start > 0 and text[n.start - 1].isalnum(), n.end < len(text) and text[n.end].isalnum(), n.start == first, noise[first],
            tag, known, len(names), sum(a in ATTRIBUTES for a in names), *(float(a in names) for a in ATTRIBUTES), n.close is not None,
            n.depth, len(n.children), inside / max(1, len(raw)), math.log1p(kinds[n.kind]), math.log1p(families[FAMILY[n.kind]]),
            math.log1p(sizes[id(n)]), math.log1p(max(0, len(raw) - inside) / sizes[id(n)]), *n.siblings,
            "\\" in raw, "^" in raw or "_" in raw or "{" in raw, bool(re.search(r"\d\s+[A-Za-z]{2,}", raw[:80])), "@" in raw,
        ]
    return nodes


@lru_cache(maxsize=1)
def model() -> Boosted:
    """Gradient-boosted trees fitted on the nodes of at most ``MAX_ROWS`` labelled texts."""
    xs, ys = [], []
    for text, parts in documents()[:MAX_ROWS]:
        starts = [a for a, _ in parts]
        for n in describe(text, parse(text)):
            xs.append(n.x)
            ys.append(float(FAMILY[n.kind] in parts[bisect_right(starts, n.start) - 1][1].split()))
    return Boosted(rounds=30, depth=4, rate=0.3, least=1.0).fit(np.array(xs, float), np.array(ys))


def decode(roots: list[Node]) -> None:
    """Choose the markup nodes: the greatest total score such that an opaque node has no chosen node inside it."""

    def best(n: Node) -> tuple[float, float]:
        below = sum(max(best(c)) for c in n.children)
        n.close_gain = (n.score + (0.0 if n.kind in OPAQUE else below), below)
        return n.close_gain

    def choose(n: Node, allowed: bool) -> None:
        yes, no = n.close_gain
        n.chosen = allowed and yes > no
        for c in n.children:
            choose(c, allowed and not (n.chosen and n.kind in OPAQUE))

    for r in roots:
        best(r)
        choose(r, True)


def analyse(texts: list[str | None], trained: Boosted | None = None) -> list[list[Node] | None]:
    """Decoded node trees of several texts, scored at once, by ``trained`` or this process's own model."""
    trees = [None if t is None else parse(t) for t in texts]
    nodes = [n for t, tree in zip(texts, trees) if tree for n in describe(t, tree)]
    if nodes:
        scores = (trained or model()).score(np.array([n.x for n in nodes], float))
        for n, s in zip(nodes, scores.tolist()):
            n.score = s
    for tree in trees:
        if tree:
            decode(tree)
    return trees


def kinds_of(tree: list[Node]) -> list[str]:
    """Families of the chosen nodes."""
    return sorted({FAMILY[n.kind] for r in tree for n in r.all() if n.chosen})


_BLOCK = frozenset("p div br tr table ul ol section article header footer blockquote pre hr body html main nav aside form".split())


def _name(raw: str) -> str:
    m = _NAME.match(raw)
    return m.group(1).lower() if m else ""


def _inside(text: str, nodes: list[Node], a: int, b: int) -> str:
    out, at = [], a
    for n in nodes:
        if n.start < at or n.end > b:
            continue
        out += [text[at : n.start], _render(text, n)]
        at = n.end
    out.append(text[at:b])
    return "".join(out)


LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
DROPPED = frozenset("cite citep citet ref eqref pageref label documentclass usepackage bibliography bibliographystyle noindent par newline vspace hspace input include".split())
VERBATIM = frozenset("verbatim lstlisting minted".split())


def _heading(level: int, title: str) -> str:
    return f"\n\n{'#' * level} {' '.join(title.split())}\n\n" if title.strip() else ""


def _render(text: str, n: Node) -> str:
    raw = text[n.start : n.end]
    if not n.chosen:
        return _inside(text, n.children, n.start, n.end)
    if n.kind == "entity":
        return html.unescape(raw)
    if n.kind in ("comment", "template", "ruler", "wtable"):
        return ""
    if n.kind == "tag":
        return "\n- " if _name(raw) == "li" and raw[1] != "/" else "\n" if _name(raw) in _BLOCK or _name(raw) == "li" else ""
    if n.kind == "element":
        name, open_end = _name(raw), raw.index(">") + 1 + n.start
        if name in ("script", "style"):
            return ""
        if name == "pre":
            code = re.sub(r"<[^<>]*>", "", text[open_end : n.close[0]])
            return f"\n```\n{html.unescape(code).strip(chr(10))}\n```\n"
        body = _inside(text, n.children, open_end, n.close[0])
        if re.fullmatch(r"h[1-6]", name):
            return _heading(int(name[1]), body)
        if name == "li":
            return f"\n- {body.strip()}"
        if name == "code":
            return f"`{body}`" if "\n" not in body else body
        return f"\n{body}\n" if name in _BLOCK else f"{body}\t" if name in ("td", "th") else body
    if n.kind == "heading":
        mark = re.match(r"#+\s*", raw).group()
        return f"{mark.strip()} {_inside(text, n.children, n.start + len(mark), n.end).strip()}"
    if n.kind in ("strong", "quotes", "emphasis", "wheading"):
        mark = re.match(r"\*+|_+|'+|=+", raw).group()
        k = len(mark)
        tail = len(raw.rstrip()) - len(raw.rstrip().rstrip(mark[0]))
        body = _inside(text, n.children, n.start + k, n.start + len(raw.rstrip()) - tail)
        return f"{'#' * k} {body.strip()}" if n.kind == "wheading" else body
    if n.kind == "mdlink":
        return _inside(text, n.children, n.start + raw.index("[") + 1, n.start + raw.index("]("))
    if n.kind == "wlink":
        if re.match(r"\[\[(?:Category|File|Image):", raw):
            return ""
        return _inside(text, n.children, n.start + max(raw.rfind("|") + 1, 2), n.end - 2)
    if n.kind == "wrow":
        return re.sub(r"\s*(?:\|\||!!)\s*", "\t", _inside(text, n.children, n.start + 1, n.end)).strip()
    if n.kind == "code":
        return raw
    if n.kind == "fence":
        return f"```\n{chr(10).join(raw.split(chr(10))[1:-1])}\n```" if "\n" in raw else ""
    if n.kind == "environment":
        name = re.search(r"\{([A-Za-z]+)", raw).group(1)
        return "```" if name in VERBATIM else "$$" if name in ("equation", "align", "displaymath", "gather") else ""
    if n.kind == "command":
        name = re.match(r"\\([A-Za-z]+)", raw).group(1)
        if name == "item":
            return "- " + raw[5:].lstrip("[").rstrip("]")
        if name in DROPPED:
            return ""
        opened = raw.find("{")
        if opened < 0:
            return raw
        last = n.start + _last_argument(raw)
        body = _inside(text, n.children, last + 1, n.end - 1)
        return _heading(LEVELS[name], body) if name in LEVELS else body
    return raw  # a formula stays as it is


def _last_argument(raw: str) -> int:
    """Where the brace of a command's last argument opens."""
    depth, opened = 0, 0
    for m in _BRACE.finditer(raw):
        for k in range(m.start(), m.end()) if m.group()[0] != "\\" else ():
            if raw[k] == "{":
                opened = k if depth == 0 else opened
                depth += 1
            else:
                depth -= 1
    return opened


def clean(text: str, tree: list[Node]) -> str:
    """The text without markup; headings as ``#`` lines, list items with ``- ``, code and formulas kept."""
    out = _inside(text, tree, 0, len(text))
    out = re.sub(r"[ \t]+\n", "\n", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n")


def markup(records: DataFrame) -> DataFrame:
    """(example_id, kinds, clean_text) per row of ``records`` (example_id, text); both null for a null text."""

    held = records.sparkSession.sparkContext.broadcast(model())

    def run(c: dict[str, list]) -> dict[str, list]:
        trees = analyse(c["text"], held.value)
        return {
            "example_id": c["example_id"],
            "kinds": [None if t is None else kinds_of(t) for t in trees],
            "clean_text": [None if t is None else clean(x, t) if t else x for x, t in zip(c["text"], trees)],
        }

    return arrow_map(records.select("example_id", "text"), run, "example_id bigint, kinds array<string>, clean_text string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of markup that a record's text holds, each record once."""
    rows = markup(read(spark, sf_dir, "example").filter("text is not null"))
    return rows.select("example_id", F.explode("kinds").alias("markup")).distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every record that holds markup, each once."""
    rows = markup(read(spark, sf_dir, "example").filter("text is not null")).filter(F.size("kinds") > 0)
    return rows.dropDuplicates(["example_id"]).select("example_id", F.array_join("kinds", ",").alias("kinds"), "clean_text")
