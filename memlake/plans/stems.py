"""Porter's stems as SQL, for oracles: his algorithm by the regular expressions of measure and vowels that he published with it."""

from __future__ import annotations

from memlake.functions.unicode import STEP_2, STEP_3, STEP_4

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
OVER_0, IS_1, OVER_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL, SHORT_END = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cut(n: int) -> str:
    return f"w[1:length(w) - {n}]"


def _suffixes(table: list[tuple[str, str]], fits: str) -> str:
    """The longest suffix of a table that a word has is replaced if what is left of the word fits."""
    rows = sorted(table, key=lambda x: (-len(x[0]), x[0]))
    return "CASE " + " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {fits.replace('STEM', _cut(len(a)))} THEN {_cut(len(a))} || '{b}' ELSE w END" for a, b in rows) + " ELSE w END"


def porter_sql(words: str, name: str = "stems") -> str:
    """Common table expressions that end in ``name`` (word, stem), from a table ``words`` (word) of distinct words. A y at the beginning is a consonant."""
    at, double = "regexp_matches(t, '(at|bl|iz)$')", "length(t) > 1 AND t[-1:] = t[-2:-2] AND regexp_matches(t, '[^aeiouylsz]$')"
    fourth = _suffixes([(s, "") for s in STEP_4], _is("STEM", OVER_1)).replace(f"WHEN ends_with(w, 'ion') THEN CASE WHEN {_is(_cut(3), OVER_1)}", f"WHEN ends_with(w, 'ion') THEN CASE WHEN {_is(_cut(3), OVER_1)} AND regexp_matches({_cut(3)}, '[st]$')")
    return f"""{name}_0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM {words} WHERE length(word) > 2 AND regexp_full_match(word, '[a-z]+')),
    {name}_1 AS (SELECT word, CASE WHEN regexp_matches(w, '(ss|i)es$') THEN {_cut(2)} WHEN regexp_matches(w, '[^s]s$') THEN {_cut(1)} ELSE w END AS w FROM {name}_0),
    {name}_2 AS (SELECT word, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {_is(_cut(2), HAS_VOWEL)} THEN {_cut(2)} WHEN ends_with(w, 'ing') AND {_is(_cut(3), HAS_VOWEL)} THEN {_cut(3)} END AS t FROM {name}_1),
    {name}_3 AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_is(_cut(3), OVER_0)} THEN {_cut(1)} ELSE w END WHEN t IS NULL THEN w WHEN {at} THEN t || 'e' WHEN {double} THEN t[1:length(t) - 1] WHEN {_is('t', SHORT_END)} THEN t || 'e' ELSE t END AS w FROM {name}_2),
    {name}_4 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND {_is(_cut(1), HAS_VOWEL)} THEN {_cut(1)} || 'i' ELSE w END AS w FROM {name}_3),
    {name}_5 AS (SELECT word, {_suffixes(STEP_2, _is('STEM', OVER_0))} AS w FROM {name}_4),
    {name}_6 AS (SELECT word, {_suffixes(STEP_3, _is('STEM', OVER_0))} AS w FROM {name}_5),
    {name}_7 AS (SELECT word, {fourth} AS w FROM {name}_6),
    {name}_8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({_is(_cut(1), OVER_1)} OR ({_is(_cut(1), IS_1)} AND NOT {_is(_cut(1), SHORT_END)})) THEN {_cut(1)} ELSE w END AS w FROM {name}_7),
    {name} AS (SELECT word, lower(CASE WHEN ends_with(w, 'll') AND {_is('w', OVER_1)} THEN {_cut(1)} ELSE w END) AS stem FROM {name}_8 UNION ALL SELECT word, word FROM {words} WHERE NOT (length(word) > 2 AND regexp_full_match(word, '[a-z]+')))"""
