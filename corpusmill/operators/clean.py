"""Source-specific clean-up.

Steps that depend on the order of lines are folded over a document's lines by a native higher-order function: no shuffle,
no Python, and every document is handled where it was read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Names of wiki sections without prose, and the patterns of book marks.
WIKI_SECTIONS = ["references", "external links", "see also", "further reading", "notes", "bibliography", "sources", "citations"]
START_MARKS = [r"\*\*\*WS*START OF (?:THE |THIS )?PROJECT GUTENBERG", r"\*\*\*WS*START OF (?:THE )?EBOOK", r"START OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK"]
END_MARKS = [r"\*\*\*WS*END OF (?:THE |THIS )?PROJECT GUTENBERG", r"\*\*\*WS*END OF (?:THE )?EBOOK", r"END OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK"]
CHAPTER = r"\nWS*(?:CHAPTER|Chapter|PART|Part)WS+[IVX1-9]"
TOC_HEAD = r"^(?:CONTENTS?|TABLE OF CONTENTS?|INDEX)WS*\z"
TOC_LINE = r"\.WS*\p{Nd}+WS*\z|^[IVX]+\z|^CHAPTERWS+[IVX\p{Nd}]+|^\z"
TOC_CAP = 50


def _ws(pattern: str) -> str:
    return pattern.replace("WS", T.WS)


def strip_wiki_sections(t: Column, sections: list[str] = WIKI_SECTIONS) -> Column:
    """Drop the sections named in ``sections`` (as substrings of a header) up to the next header of any level."""
    lines = F.transform(
        F.split(t, "\n"),
        lambda x: F.struct(x.alias("x"), F.lower(T.strip(x)).alias("low")),
    )
    marked = F.transform(
        lines,
        lambda s: F.struct(
            s["x"].alias("x"),
            (s["low"].startswith("==") | s["low"].endswith("==")).alias("head"),
            T.contains_any(F.regexp_replace(s["low"], r"^[= ]+|[= ]+\z", ""), sections).alias("drop"),
        ),
    )
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        skip = F.when(s["head"], s["drop"]).otherwise(a["skip"])
        return F.struct(skip.alias("skip"), F.when(skip, a["out"]).otherwise(F.concat(a["out"], F.array(s["x"]))).alias("out"))

    return F.array_join(F.aggregate(marked, start, step)["out"], "\n")


def strip_wiki_markup(t: Column) -> Column:
    """Drop templates, reduce links to what they show, drop brackets, shorten runs of line breaks, strip."""
    t = F.regexp_replace(t, r"\{\{[^}]*\}\}", "")
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[|\]", "")
    return T.strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def _first(t: Column, patterns: list[str], before: bool) -> Column:
    """1-based start (``before``) or end of the first match of the first pattern that matches; null if none does."""
    out = F.lit(None).cast("int")
    for p in reversed(patterns):
        p = _ws(p)
        at = F.regexp_instr(t, F.lit(f"(?i){p}"))
        end = at if before else at + F.length(F.regexp_substr(t, F.lit(f"(?i){p}")))
        out = F.when(at > 0, end).otherwise(out)
    return out


def strip_book_marks(t: Column) -> Column:
    """The text between the start and end marks of a book; without a start mark, from the first chapter heading on."""
    after = _first(t, START_MARKS, False)  # the character after the mark
    stop = _first(t, END_MARKS, True)
    cut = F.locate("\n", F.substr(t, F.coalesce(after, F.lit(1))))
    begin = F.when(after.isNull(), F.lit(0)).when(cut > 0, after - 1 + cut).otherwise(after - 1)
    head = F.substr(t, F.lit(1), F.greatest(F.coalesce(stop, F.lit(1)) - 1, F.lit(0)))
    back = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    end = F.when(stop.isNull(), F.length(t)).when(F.contains(head, F.lit("\n")), back - 1).otherwise(stop - 1)
    chapter = F.regexp_instr(t, F.lit(_ws(CHAPTER)))
    begin = F.when((begin == 0) & (chapter > 0), chapter - 1).otherwise(begin)
    return T.strip(F.when(end > begin, F.substr(t, begin + 1, F.greatest(end - begin, F.lit(0)))).otherwise(F.lit("")))


def strip_toc(t: Column) -> Column:
    """Drop tables of contents: a header line and the contents lines after it, 51 at most."""
    lines = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("x"), F.upper(T.strip(x)).alias("u")))
    start = F.struct(F.lit(False).alias("toc"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        head = F.rlike(s["u"], F.lit(_ws(TOC_HEAD)))
        inside = a["toc"] & (F.length(s["u"]) < 80) & F.rlike(s["u"], F.lit(_ws(TOC_LINE)))
        n = a["n"] + 1
        return (
            F.when(head, F.struct(F.lit(True).alias("toc"), F.lit(0).alias("n"), a["out"].alias("out")))
            .when(inside, F.struct((n <= TOC_CAP).alias("toc"), n.alias("n"), a["out"].alias("out")))
            .otherwise(F.struct(F.lit(False).alias("toc"), a["n"].alias("n"), F.concat(a["out"], F.array(s["x"])).alias("out")))
        )

    return F.array_join(F.aggregate(lines, start, step)["out"], "\n")


def merge_wrapped(t: Column) -> Column:
    """Join words hyphenated at line ends and hard-wrapped lines.

    A line goes on in the next one if both are not blank, it doesn't end with one of ``.!?:;"'`` and the next doesn't start
    with a capital. That depends on the characters around the break only, so one pattern finds the breaks to join.
    """
    t = F.regexp_replace(F.regexp_replace(t, rf"-\n{T.WS}*", ""), r"[ \t]+", " ")
    stripped = F.array_join(F.transform(F.split(t, "\n"), T.strip), "\n")
    return F.regexp_replace(stripped, r"(?<=[^\n.!?:;\"'])\n(?=[^\n\p{Lu}])", " ")
