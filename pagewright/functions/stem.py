"""Word stems after Porter (1980), with diacritics folded: the forms under which keyword search finds words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The suffixes of steps 2, 3 and 4, and what takes their place.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_STEP_4 = dict.fromkeys(STEP_4, "")
LONGEST = max(map(len, [*STEP_2, *STEP_3, *STEP_4]))
SHORTEST = 3


def folded(word: str) -> str:
    """Without diacritics."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


_SOUNDS = {ord(c): "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxz"}


def _sounds(word: str) -> str:
    """v and c by letter: y is a vowel after a consonant."""
    out = word.translate(_SOUNDS)
    while (at := out.find("y")) >= 0:
        out = out[:at] + ("v" if out[at - 1 : at] == "c" else "c") + out[at + 1 :]
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _sounds(stem).count("vc")


def _short(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last none of w, x and y."""
    return _sounds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table replaced, if ``least`` vowels and consonants are left before it."""
    for n in range(min(LONGEST, len(word)), 1, -1):
        suffix = word[-n:]
        if suffix in table:
            stem = word[:-n]
            if (suffix != "ion" or stem[-1:] in ("s", "t")) and _measure(stem) >= least:
                return stem + table[suffix]
            break
    return word


def _endings(word: str) -> str:
    """Steps 1a to 1c: plurals, -ed and -ing, and a last y."""
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix):
                if "v" in _sounds(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word[-1:] == word[-2:-1] and _sounds(word)[-1:] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    return word[:-1] + "i" if word.endswith("y") and "v" in _sounds(word[:-1]) else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of fewer than three letters, or with others than a to z, stay."""
    word = folded(word)
    if len(word) < SHORTEST or not (word.isascii() and word.isalpha()):
        return word
    word = _swap(_swap(_endings(word), STEP_2, 1), STEP_3, 1)
    word = _swap(word, _STEP_4, 2)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stems of a column of words, each distinct word of a batch worked out once."""
    codes, distinct = pd.factorize(words)
    return pd.Series([stem(w) for w in distinct], dtype=object).take(codes).reset_index(drop=True)


def sql(words: str) -> list[str]:
    """CTEs of DuckDB SQL that stem the column ``w`` of the table ``words``: the last is ``stemmed`` (w, s).

    Made of regular expressions over words whose vowel y is written Y.
    """
    v, c = "[aeiouY]", "[^aeiouY]"
    m = {1: f"^{c}*{v}+{c}", 2: f"^{c}*{v}+{c}+{v}+{c}"}
    short = f"{c}{v}[^aeiouYwxy]$"
    double = "(" + "|".join(x * 2 for x in "bcdfghjkmnpqrtvwxy") + ")$"
    low = lambda x: f"regexp_replace(lower({x}), '([bcdfghjklmnpqrstvwxyz])y', '\\1Y', 'g')"
    cut = lambda n: f"left(s, length(s) - {n})"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"
    ends = lambda *xs: has("s", "(" + "|".join(x.replace("y", "[yY]") for x in xs) + ")$")

    def table(rows: dict[str, str], least: int) -> str:
        cases = []
        for x in sorted(rows, key=lambda x: (-len(x), x)):
            more = f" AND {has(cut(3), '[st]$')}" if x == "ion" else ""
            cases.append(f"WHEN {ends(x)} THEN CASE WHEN {has(cut(len(x)), m[least])}{more} THEN {cut(len(x))} || '{rows[x]}' ELSE s END")
        return f"CASE {' '.join(cases)} ELSE s END"

    steps = [
        f"CASE WHEN {ends('sses', 'ies')} THEN {cut(2)} WHEN {ends('ss')} THEN s WHEN {ends('s')} THEN {cut(1)} ELSE s END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {has(cut(3), m[1])} THEN {cut(1)} ELSE s END WHEN {ends('ed')} AND {has(cut(2), v)} THEN {cut(2)} || '+'"
        f" WHEN {ends('ed')} THEN s WHEN {ends('ing')} AND {has(cut(3), v)} THEN {cut(3)} || '+' ELSE s END",
        f"CASE WHEN right(s, 1) <> '+' THEN s ELSE (SELECT CASE WHEN {has('t', '(at|bl|iz)$')} THEN t || 'e' WHEN {has('t', double)} THEN left(t, length(t) - 1)"
        f" WHEN {has('t', m[1])} AND NOT {has('t', m[2])} AND {has('t', short)} THEN t || 'e' ELSE t END FROM (SELECT {cut(1)} AS t)) END",
        f"CASE WHEN {ends('y')} AND {has(cut(1), v)} THEN {cut(1)} || 'i' ELSE s END",
        table(STEP_2, 1),
        table(STEP_3, 1),
        table(dict.fromkeys(STEP_4, ""), 2),
        f"CASE WHEN {ends('e')} AND ({has(cut(1), m[2])} OR ({has(cut(1), m[1])} AND NOT {has(cut(1), short)})) THEN {cut(1)} ELSE s END",
        f"CASE WHEN {ends('ll')} AND {has('s', m[2])} THEN {cut(1)} ELSE s END",
    ]
    out = [f"stem0 AS (SELECT DISTINCT w, strip_accents(w) AS s FROM {words})"]
    for k, step in enumerate(steps):
        here = low("s") if k != 2 else "s"
        out.append(f"stem{k + 1} AS MATERIALIZED (SELECT w, {step} AS s FROM (SELECT w, {here} AS s FROM stem{k} WHERE regexp_full_match(lower(s), '[a-z+]{{3,}}') OR {k} > 0))")
    last = f"stem{len(steps)}"
    out.append(f"stemmed AS MATERIALIZED (SELECT a.w, coalesce(lower({last}.s), a.s) AS s FROM stem0 a LEFT JOIN {last} ON a.w = {last}.w AND regexp_full_match(a.s, '[a-z]{{3,}}'))")
    return out
