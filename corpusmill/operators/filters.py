"""Quality rules as predicates, and verdicts that carry the first rule broken.

Each rule is a pair of builders: a native column and the SQL that DuckDB checks it with. A verdict is one CASE chain from
cheap to expensive rules, so that Spark evaluates a rule only where the ones before it passed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T

# Phrases and keywords of the rules.
BOILERPLATE = [
    "cookie policy", "privacy policy", "terms of service", "all rights reserved", "subscribe to our newsletter", "sign up to continue", "log in to continue",
    "enable javascript", "accept cookies", "we use cookies", "javascript is required", "please enable cookies",
]
WEB_JUNK = [
    "shipping", "add to cart", "buy now", "coupon", "free download", "click here", "affiliate", "checkout", "price $", "order now", "limited time", "sale ends", "discount code",
    "betting tips", "free bets", "betting predictions", "soccer predictions", "football predictions", "sports betting", "bet now", "odds today", "inplay bet", "in-play bet", "bookmaker",
    "casino bonus", "free spins", "slot machine", "poker bonus",
    "seo services", "backlinks", "link building", "guest post", "sponsored post",
    "crypto trading", "bitcoin trading", "forex trading", "make money online", "work from home", "passive income",
    "startup venture", "our company", "our team", "our services", "we offer", "we provide", "contact us today", "get in touch", "learn more about our", "schedule a consultation",
    "free consultation", "our experts", "industry leader", "market leader", "best in class", "cutting-edge solution", "innovative solution", "revolutionizing", "game-changing", "world-class",
    "trusted by", "testimonial",
]
NAV_WORDS = ["home", "about", "contact", "privacy", "terms", "faq", "sitemap"]
SPAM_RUNS = r"/{4,}|\|{4,}|={4,}|-{4,}|'{6,}|\"{6,}"
LIST_LINE = r"^WS*[*\-•]WS|^WS*\p{Nd}+[.)]WS|^WS*[a-zA-Z][.)]WS"


@dataclass(frozen=True)
class Limits:
    """Limits and word lists of the rules; names follow the configuration table where it has them."""

    min_chars: int = 300
    max_chars: int = 80000
    min_alpha_ratio: float = 0.65
    max_repeated_chars: int = 6
    max_weird_ratio: float = 0.01
    max_short_line_ratio: float = 0.30
    max_caps_ratio: float = 0.20
    c4_min_alpha_ratio: float = 0.70
    c4_max_punct_ratio: float = 0.20
    c4_min_entropy: float = 3.5
    c4_max_entropy: float = 5.6
    wiki_max_list_ratio: float = 0.30
    gutenberg_filter_poetry: bool = False
    max_chunk_chars: int = 8000
    min_chunk_chars: int = 500
    short_line: int = 20
    web_junk: int = 2
    nav_words: int = 4
    pipe_ratio: float = 0.005
    min_paragraphs: int = 2
    min_paragraph_chars: int = 200
    poetry_share: float = 0.50
    poetry_line: int = 40
    min_sentences: int = 2
    boilerplate: tuple[str, ...] = tuple(BOILERPLATE)
    junk_words: tuple[str, ...] = tuple(WEB_JUNK)
    nav_list: tuple[str, ...] = tuple(NAV_WORDS)


BASE = Limits()


def _repeat(t: Column, n: int) -> Column:
    return F.lit(True) if n <= 0 else ~F.rlike(t, F.lit(rf"([^\n])\1{{{n - 1},}}"))


def _line_structure(t: Column, m: Limits) -> Column:
    def shares(lines: Column) -> Column:
        short = T.count_lines(lines, lambda x: F.length(T.strip(x)) < m.short_line)
        letters = F.filter(lines, lambda x: F.rlike(x, F.lit(r"\p{L}")))
        caps = T.let(letters, lambda some: T.share(T.count_lines(some, lambda x: ~F.rlike(x, F.lit(r"[\p{L}&&[^\p{Lu}]]"))), F.size(some)) <= m.max_caps_ratio)
        return (T.share(short, F.size(lines)) <= m.max_short_line_ratio) & caps

    return T.let(T.full_lines(t), shares)


def _paragraphs(t: Column, m: Limits) -> Column:
    real = F.filter(F.transform(F.split(t, "\n+"), T.strip), lambda p: F.length(p) > 30)

    def good(some: Column) -> Column:
        total = F.aggregate(some, F.lit(0), lambda a, p: a + F.length(p))
        return F.when(F.size(some) == 0, F.length(T.strip(t)) >= 300).otherwise((F.size(some) >= m.min_paragraphs) & (T.share(total, F.size(some)) >= m.min_paragraph_chars))

    return T.let(real, good)


def _short_paragraphs(t: Column, m: Limits) -> Column:
    return F.exists(F.split(t, rf"\n{T.WS}*\n"), lambda p: T.sentence_count(T.strip(p)) >= m.min_sentences)


def _line_share(t: Column, test) -> Column:
    return T.let(T.full_lines(t), lambda lines: T.share(T.count_lines(lines, test), F.size(lines)))


def _sql_lines(t: str, m: Limits) -> str:
    lines = S.full_lines(t)
    letters = rf"list_filter({lines}, lambda x: regexp_matches(x, '\p{{L}}'))"
    caps = rf"len(list_filter({letters}, lambda x: not regexp_matches(x, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]')))"
    short = f"len(list_filter({lines}, lambda x: length({S.strip('x')}) < {m.short_line}))"
    return f"({S.share(short, f'len({lines})')} <= {m.max_short_line_ratio} and {S.share(caps, f'len({letters})')} <= {m.max_caps_ratio})"


def _sql_repeat(t: str, n: int) -> str:
    """Without back references: one alternative per ASCII character, and a slower test for texts with other runs."""
    ascii_runs = "|".join(rf"\x{{{c:02X}}}{{{n}}}" for c in range(128) if c != 10)
    other = f"coalesce(list_bool_or(list_transform(regexp_extract_all({t}, '[^\\x00-\\x7F]{{{n},}}'), lambda r: list_bool_or(list_transform(range(1, length(r) - {n - 2}), lambda i: substr(r, i, {n}) = repeat(substr(r, i, 1), {n}))))), false)"
    return f"not (regexp_matches({t}, {S.q(ascii_runs)}) or {other})"


def _sql_paragraphs(t: str, m: Limits) -> str:
    real = f"list_filter(list_transform(string_split(regexp_replace({t}, chr(10) || '+', chr(10), 'g'), chr(10)), lambda p: {S.strip('p')}), lambda p: length(p) > 30)"
    total = f"coalesce(list_sum(list_transform({real}, lambda p: length(p))), 0)"
    return f"(case when len({real}) = 0 then length({S.strip(t)}) >= 300 else len({real}) >= {m.min_paragraphs} and {S.share(total, f'len({real})')} >= {m.min_paragraph_chars} end)"


def _sql_contained(t: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({t}), {S.q(w)})::int" for w in words) + ")"


def _sql_short_paragraphs(t: str, m: Limits) -> str:
    split = f"string_split(regexp_replace({t}, {S.q(chr(92) + 'n' + S.WS + '*' + chr(92) + 'n')}, chr(1), 'g'), chr(1))"
    return f"coalesce(list_bool_or(list_transform({split}, lambda p: {S.sentence_count(S.strip('p'))} >= {m.min_sentences})), false)"


def _sql_share(t: str, test: str) -> str:
    return S.share(f"len(list_filter({S.full_lines(t)}, lambda x: {test}))", f"len({S.full_lines(t)})")


Rule = tuple[Callable[[Column, Limits], Column], Callable[[str, Limits], str]]

RULES: dict[str, Rule] = {
    "G0_length": (lambda t, m: F.length(t).between(m.min_chars, m.max_chars), lambda t, m: f"length({t}) between {m.min_chars} and {m.max_chars}"),
    "G1_alpha_ratio": (lambda t, m: T.alpha_ratio(t) >= m.min_alpha_ratio, lambda t, m: f"{S.alpha_ratio(t)} >= {m.min_alpha_ratio}"),
    "G2_repeated_chars": (lambda t, m: _repeat(t, m.max_repeated_chars), lambda t, m: _sql_repeat(t, m.max_repeated_chars)),
    "G3_weird_symbols": (lambda t, m: T.weird_ratio(t) <= m.max_weird_ratio, lambda t, m: f"{S.weird_ratio(t)} <= {m.max_weird_ratio}"),
    "G4_line_structure": (_line_structure, _sql_lines),
    "G5_boilerplate": (lambda t, m: T.let(F.lower(t), lambda low: ~T.contains_any(low, m.boilerplate)), lambda t, m: f"{_sql_contained(t, m.boilerplate)} = 0"),
    "C1_alpha_ratio": (lambda t, m: T.alpha_ratio(t) >= m.c4_min_alpha_ratio, lambda t, m: f"{S.alpha_ratio(t)} >= {m.c4_min_alpha_ratio}"),
    "C2_punct_spam": (lambda t, m: (T.punct_ratio(t) <= m.c4_max_punct_ratio) & ~F.rlike(t, F.lit(SPAM_RUNS)), lambda t, m: f"({S.punct_ratio(t)} <= {m.c4_max_punct_ratio} and not regexp_matches({t}, {S.q(SPAM_RUNS)}))"),
    "C3_web_junk": (lambda t, m: T.let(F.lower(t), lambda low: T.count_contained(low, m.junk_words) < m.web_junk), lambda t, m: f"{_sql_contained(t, m.junk_words)} < {m.web_junk}"),
    "C4_nav_patterns": (
        lambda t, m: T.let(F.lower(t), lambda low: T.count_contained(low, m.nav_list) < m.nav_words) & (T.share(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))), F.length(t)) <= m.pipe_ratio),
        lambda t, m: f"({_sql_contained(t, m.nav_list)} < {m.nav_words} and {S.share(f'length({t}) - length(replace({t}, {S.q(chr(124))}, {S.q(str())}))', f'length({t})')} <= {m.pipe_ratio})",
    ),
    "C5_paragraph_quality": (_paragraphs, _sql_paragraphs),
    "C6_entropy": (lambda t, m: T.entropy(t).between(m.c4_min_entropy, m.c4_max_entropy), lambda t, m: f"{S.entropy(t)} between {m.c4_min_entropy} and {m.c4_max_entropy}"),
    "W1_list_heavy": (
        lambda t, m: _line_share(t, lambda x: F.rlike(x, F.lit(LIST_LINE.replace("WS", T.WS)))) <= m.wiki_max_list_ratio,
        lambda t, m: f"{_sql_share(t, f'regexp_matches(x, {S.q(LIST_LINE.replace(chr(87) + chr(83), S.WS))})')} <= {m.wiki_max_list_ratio}",
    ),
    "W2_short_paragraphs": (_short_paragraphs, _sql_short_paragraphs),
    "GUT2_poetry_heavy": (lambda t, m: _line_share(t, lambda x: F.length(T.strip(x)) < m.poetry_line) <= m.poetry_share, lambda t, m: f"{_sql_share(t, f'length({S.strip(chr(120))}) < {m.poetry_line}')} <= {m.poetry_share}"),
}
GLOBAL = ["G0_length", "G1_alpha_ratio", "G2_repeated_chars", "G3_weird_symbols", "G4_line_structure", "G5_boilerplate"]
WEB = ["C1_alpha_ratio", "C2_punct_spam", "C3_web_junk", "C4_nav_patterns", "C5_paragraph_quality", "C6_entropy"]
WIKI = ["W1_list_heavy", "W2_short_paragraphs"]


def passes(rule: str, t: Column, m: Limits = BASE) -> Column:
    """Whether a text keeps a rule; null for a null text."""
    return RULES[rule][0](t, m)


def passes_sql(rule: str, t: str, m: Limits = BASE) -> str:
    """The same in SQL."""
    return RULES[rule][1](t, m)


def reason(t: Column, rules: list[str], m: Limits = BASE) -> Column:
    """The first rule that a text breaks, in order; '' if none, ``null_text`` for a null text."""
    out = F.when(t.isNull(), F.lit("null_text"))
    for r in rules:
        out = out.when(~passes(r, t, m), F.lit(r))
    return out.otherwise(F.lit(""))


def reason_sql(t: str, rules: list[str], m: Limits = BASE) -> str:
    """The same in SQL."""
    return f"(case when {t} is null then 'null_text' " + " ".join(f"when not ({passes_sql(r, t, m)}) then '{r}'" for r in rules) + " else '' end)"
