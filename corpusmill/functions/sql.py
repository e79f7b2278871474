"""The same features as expressions of DuckDB's SQL, for checking queries."""

from __future__ import annotations

WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    """Without white space at both ends."""
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def share(a: str, b: str) -> str:
    """A quotient as a double, 0 where the divisor is 0."""
    return f"(case when {b} = 0 then 0.0::double else ({a})::double / {b} end)"


def alpha_ratio(t: str) -> str:
    """Share of letters."""
    return share(rf"length(regexp_replace({t}, '[^\p{{L}}]', '', 'g'))", f"length({t})")


def weird_ratio(t: str) -> str:
    """Share of characters outside ASCII text."""
    return share(rf"length(regexp_replace({t}, '[\x20-\x7E\t\n\r\x0B\f]', '', 'g'))", f"length({t})")


def punct_ratio(t: str) -> str:
    """Share of spam marks."""
    return share(rf"""length({t}) - length(regexp_replace({t}, '[.,;:/|=_\\"''-]', '', 'g'))""", f"length({t})")


def chars(t: str) -> str:
    """List of code points."""
    return f"regexp_extract_all({t}, '(?s).')"


def entropy(t: str) -> str:
    """Shannon entropy in bits."""
    n = f"length({t})"
    one = f"(({n} - length(replace({t}, c, '')))::double / {n})"
    return f"(case when {n} = 0 then 0.0::double else coalesce(list_sum(list_transform(list_distinct({chars(t)}), lambda c: -{one} * log2({one}))), 0.0) end)"


def sentence_count(t: str) -> str:
    """Runs of end marks before white space or the end."""
    return f"len(regexp_extract_all({t}, {q(rf'[.!?]+(?:{WS}|$)')}))"


def full_lines(t: str) -> str:
    """Lines that are not blank."""
    return f"list_filter(string_split({t}, chr(10)), lambda x: {strip('x')} <> '')"


def dedup_key(t: str, n: int = 200) -> str:
    """Normalised prefix."""
    lowered = f"regexp_replace(lower({t}), {q(WS + '+')}, ' ', 'g')"
    return f"substr({strip(lowered)}, 1, {n})"
