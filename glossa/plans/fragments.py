"""DuckDB fragments that say the same as the text functions, for the oracle SQL."""

from __future__ import annotations

from ..functions import lexicon as L


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def mapping(table: dict) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def rounded(value: str, digits: int) -> str:
    """By the decimal expansion of the double's binary amount."""
    return f"format('{{:.{digits}f}}', ({value})::DOUBLE)::DOUBLE"


SPACE = r"[\s\x0b\x{85}\p{Z}]"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{SPACE}+', ' ', 'g'))"


def tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z][A-Za-z''’‘-]*'), lambda t: trim(translate(lower(t), '’‘', ''''''), ''''))"


def lemma(t: str) -> str:
    return (
        f"coalesce(map_extract({mapping(L.IRREGULAR)}, {t})[1], CASE WHEN len({t}) > 4 AND ends_with({t}, 'ies') THEN left({t}, len({t}) - 3) || 'y' "
        f"WHEN len({t}) > 5 AND ends_with({t}, 'ing') THEN left({t}, len({t}) - 3) WHEN len({t}) > 4 AND ends_with({t}, 'ed') THEN left({t}, len({t}) - 2) "
        f"WHEN len({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN left({t}, len({t}) - 1) ELSE {t} END)"
    )


def content(text: str) -> str:
    return f"list_transform(list_filter({tokens(text)}, lambda t: len(t) > 2 AND NOT list_contains({listing(L.STOPWORDS)}, t)), lambda t: {lemma('t')})"


def sentences(text: str) -> str:
    import re

    held = f"coalesce({text}, '')"
    for a in L.ABBREVIATIONS:
        held = f"regexp_replace({held}, {quoted(re.escape(a))}, {quoted(a.replace('.', chr(1)))}, 'gi')"
    for _ in range(2):
        held = f"regexp_replace({held}, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z])\\.', '\\1\\2' || chr(1), 'g')"
    parts = f"string_split(regexp_replace({trimmed(held)}, '([.!?]){SPACE}+', '\\1' || chr(2), 'g'), chr(2))"
    return f"list_filter(list_transform({parts}, lambda s: {trimmed('replace(s, chr(1), chr(46))')}), lambda s: s <> '')"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def plain(text: str) -> str:
    """Beyond ASCII: blanks as a blank, letters, digits and marks as _, all else as #.

    DuckDB's word boundaries know ASCII only; with this they lie where Spark's do.
    """
    spaces = f"regexp_replace({text}, '[\\x{{85}}\\p{{Z}}]', ' ', 'g')"
    return f"regexp_replace(regexp_replace({spaces}, '[^\\x00-\\x7f\\p{{L}}\\p{{N}}\\p{{M}}]', '#', 'g'), '[^\\x00-\\x7f]', '_', 'g')"


def words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(coalesce({text}, ''), '{SPACE}+', ' ', 'g'), ' '), lambda w: w <> '')"


C = f"c AS (SELECT doc_id, {content('text')} AS w FROM documents)"
R = C + ", r AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM c)"
S = f"s0 AS (SELECT doc_id, {sentences('text')} AS ss FROM documents), s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM s0)"
