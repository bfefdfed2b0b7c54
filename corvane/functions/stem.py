"""English stems of lower-case words by the Porter2 rules, as staged SQL that Spark and DuckDB both run.

Each stage adds one column to a table of distinct words, so that no expression is repeated inside another.  The rules
are the published ones of the Snowball English stemmer; words here have letters and digits only, so its step for
apostrophes falls away.  ``stem`` runs the same stages inside a task that meets the words there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words with a stem of their own, and words that stay as they are (before, and after, plurals go).
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

#: Endings with their replacement and, where there is one, a pattern that must precede.
STEP_2 = (
    ("ational", "ate", ""), ("fulness", "ful", ""), ("iveness", "ive", ""), ("ization", "ize", ""), ("ousness", "ous", ""),
    ("biliti", "ble", ""), ("lessli", "less", ""), ("tional", "tion", ""), ("alism", "al", ""), ("aliti", "al", ""),
    ("ation", "ate", ""), ("entli", "ent", ""), ("fulli", "ful", ""), ("iviti", "ive", ""), ("ousli", "ous", ""),
    ("abli", "able", ""), ("alli", "al", ""), ("anci", "ance", ""), ("ator", "ate", ""), ("enci", "ence", ""), ("izer", "ize", ""),
    ("bli", "ble", ""), ("ogi", "og", "l$"), ("li", "", "[cdeghkmnrt]$"),
)
STEP_3 = (
    ("ational", "ate", ""), ("tional", "tion", ""), ("alize", "al", ""), ("ative", "", "in R2"), ("icate", "ic", ""),
    ("iciti", "ic", ""), ("ical", "ic", ""), ("ness", "", ""), ("ful", "", ""),
)
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _less(w: str, n: int) -> str:
    return f"substr({w}, 1, length({w}) - {n})"


def _endings(w: str, rules, region: str, match) -> str:
    """The longest ending that fits is replaced if it stands in the region."""
    cases = []
    for ending, other, before in rules:
        n = len(ending)
        fits = f"length({w}) - {n} >= {'r2' if before == 'in R2' else region}"
        if before and before != "in R2":
            fits += f" AND {match(_less(w, n), before)}"
        cases.append(f"WHEN {w} LIKE '%{ending}' THEN CASE WHEN {fits} THEN {_less(w, n)} || '{other}' ELSE {w} END")
    return f"CASE {' '.join(cases)} ELSE {w} END"


def stages(match) -> list[tuple[str, str]]:
    """(column, SQL) in order, from the column ``w`` to the column ``lexeme``; ``match(text, pattern)`` gives SQL."""
    y = "regexp_replace(w, '^y', 'Y')"
    for vowel in "aeiouy":
        y = f"replace({y}, '{vowel}y', '{vowel}Y')"
    own = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in OWN.items())
    cut = " ".join(f"WHEN b LIKE '%{x}' THEN {_less('b', len(x))}" for x in ("ingly", "edly", "ing", "ed"))
    return [
        ("own", f"CASE WHEN length(w) <= 2 OR w IN ({_quoted(KEPT)}) THEN w {own} END"),
        ("a", y),
        ("r1", f"CASE WHEN a LIKE 'gener%' OR a LIKE 'arsen%' THEN 5 WHEN a LIKE 'commun%' THEN 6 ELSE coalesce(nullif(length(regexp_extract(a, '{_REGION}', 0)), 0), length(a)) END"),
        ("r2", f"r1 + coalesce(nullif(length(regexp_extract(substr(a, r1 + 1), '{_REGION}', 0)), 0), length(a) - r1)"),
        ("b", f"CASE WHEN a LIKE '%sses' THEN {_less('a', 2)} WHEN a LIKE '%ied' OR a LIKE '%ies' THEN CASE WHEN length(a) > 4 THEN {_less('a', 2)} ELSE {_less('a', 1)} END "
              f"WHEN a LIKE '%us' OR a LIKE '%ss' THEN a WHEN {match('a', '[aeiouy].+s$')} THEN {_less('a', 1)} ELSE a END"),
        ("c0", f"CASE WHEN b LIKE '%eed' OR b LIKE '%eedly' THEN NULL {cut} END"),
        ("c", f"CASE WHEN b LIKE '%eedly' THEN CASE WHEN length(b) - 5 >= r1 THEN {_less('b', 3)} ELSE b END WHEN b LIKE '%eed' THEN CASE WHEN length(b) - 3 >= r1 THEN {_less('b', 1)} ELSE b END "
              f"WHEN c0 IS NULL THEN b WHEN NOT {match('c0', '[aeiouy]')} THEN b WHEN c0 LIKE '%at' OR c0 LIKE '%bl' OR c0 LIKE '%iz' THEN c0 || 'e' "
              f"WHEN {match('c0', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_less('c0', 1)} WHEN r1 >= length(c0) AND {match('c0', _SHORT)} THEN c0 || 'e' ELSE c0 END"),
        ("d", f"CASE WHEN {match('c', '.[^aeiouy][yY]$')} THEN {_less('c', 1)} || 'i' ELSE c END"),
        ("e", _endings("d", STEP_2, "r1", match)),
        ("f", _endings("e", STEP_3, "r1", match)),
        ("g", _endings("f", [(x, "", "[st]$" if x == "ion" else "") for x in STEP_4], "r2", match)),
        ("h", f"CASE WHEN g LIKE '%e' AND (length(g) - 1 >= r2 OR length(g) - 1 >= r1 AND NOT {match(_less('g', 1), _SHORT)}) THEN {_less('g', 1)} WHEN g LIKE '%ll' AND length(g) - 1 >= r2 THEN {_less('g', 1)} ELSE g END"),
        ("lexeme", f"coalesce(own, CASE WHEN b IN ({_quoted(KEPT_LATER)}) THEN b END, replace(h, 'Y', 'y'))"),
    ]


def stemmed(words: DataFrame) -> DataFrame:
    """(w, lexeme) of ``words`` (w)."""
    out = words.select("w")
    for name, sql in stages(lambda text, pattern: f"({text}) RLIKE '{pattern}'"):
        out = out.withColumn(name, F.expr(sql))
    # a generator's output: filters on the lexeme, which joins infer, are not pushed below it and so not unfolded
    return out.select("w", F.explode(F.array("lexeme")).alias("lexeme"))


_REGION_RE, _SHORT_RE, _VOWEL_RE = re.compile(_REGION), re.compile(_SHORT), re.compile("[aeiouy]")
_PLURAL_RE, _DOUBLE_RE, _FINAL_Y_RE = re.compile("[aeiouy].+s$"), re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), re.compile(".[^aeiouy][yY]$")
_RULES = [(tuple(x[0] for x in rules), [(ending, other, before == "in R2", re.compile(before if before != "in R2" else "")) for ending, other, before in rules])
          for rules in (STEP_2, STEP_3, [(x, "", "[st]$" if x == "ion" else "") for x in STEP_4])]


def _replaced(w: str, step: int, region: int, r2: int) -> str:
    endings, rules = _RULES[step]
    if not w.endswith(endings):
        return w
    for ending, other, in_r2, before in rules:
        if w.endswith(ending):
            rest = w[: -len(ending)]
            return rest + other if len(rest) >= (r2 if in_r2 else region) and before.search(rest) else w


def stem(w: str) -> str:
    """The lexeme of one word: :func:`stages`, column by column."""
    if len(w) <= 2 or w in KEPT:
        return w
    if w in OWN:
        return OWN[w]
    a = w
    if "y" in a:
        a = "Y" + a[1:] if a[0] == "y" else a
        for vowel in "aeiouy":
            a = a.replace(vowel + "y", vowel + "Y")
    if a.startswith(("gener", "arsen")):
        r1 = 5
    elif a.startswith("commun"):
        r1 = 6
    else:
        found = _REGION_RE.match(a)
        r1 = found.end() if found else len(a)
    found = _REGION_RE.match(a[r1:])
    r2 = r1 + found.end() if found else len(a)
    b = a
    if a.endswith("sses"):
        b = a[:-2]
    elif a.endswith(("ied", "ies")):
        b = a[:-2] if len(a) > 4 else a[:-1]
    elif a.endswith("s") and not a.endswith(("us", "ss")) and _PLURAL_RE.search(a):
        b = a[:-1]
    if b in KEPT_LATER:
        return b
    c = b
    if b.endswith("eedly"):
        c = b[:-3] if len(b) - 5 >= r1 else b
    elif b.endswith("eed"):
        c = b[:-1] if len(b) - 3 >= r1 else b
    else:
        cut = next((len(x) for x in ("ingly", "edly", "ing", "ed") if b.endswith(x)), 0)
        c0 = b[:-cut] if cut else ""
        if _VOWEL_RE.search(c0):
            if c0.endswith(("at", "bl", "iz")):
                c = c0 + "e"
            elif _DOUBLE_RE.search(c0):
                c = c0[:-1]
            else:
                c = c0 + "e" if r1 >= len(c0) and _SHORT_RE.search(c0) else c0
    d = c[:-1] + "i" if c.endswith(("y", "Y")) and _FINAL_Y_RE.search(c) else c
    g = _replaced(_replaced(_replaced(d, 0, r1, r2), 1, r1, r2), 2, r2, r2)
    n = len(g) - 1
    if g.endswith("e") and (n >= r2 or n >= r1 and not _SHORT_RE.search(g[:-1])) or g.endswith("ll") and n >= r2:
        g = g[:-1]
    return g.replace("Y", "y")


def _cut_parts() -> list[list[str]]:
    """What each stage can cut from a word's own letters, the last stage first.

    A part is an ending without the letters that its replacement begins with; the letters that an earlier stage has put
    at its end (see :func:`heads`) are not the word's own.
    """
    groups = [["e", "l"]]
    for rules in (((x, "", "") for x in STEP_4), STEP_3, STEP_2):
        parts = set()
        for ending, other, _ in rules:
            same = next((i for i, (x, y) in enumerate(zip(ending, other)) if x != y), len(other))
            parts |= {ending[same : len(ending) - len(put)] for put in ("", "e", "i", "le") if ending.endswith(put)}
        groups.append(sorted(parts))
    ends = ["ed", "ing", "edly", "ingly"]
    return [*groups, ["y"], [x + y for x in ("", *"bdfgmnprt") for y in ends] + ["d", "dly"], ["es", "ed", "s", "d"]]


#: The first and the last three letters of what they cut together, or all of it.
CUT_STARTS, CUT_ENDS = {""}, {""}
for _parts in _cut_parts():
    CUT_STARTS |= {(x + y)[:3] for x in CUT_STARTS for y in _parts}
for _parts in reversed(_cut_parts()):
    CUT_ENDS |= {(y + x)[-3:] for x in CUT_ENDS for y in _parts}


def heads(lexeme: str) -> set[str]:
    """Beginnings of which any word of this lexeme has one, but for the words in OWN; what follows it
    begins and ends as in CUT_STARTS and CUT_ENDS.

    Stages cut endings, and what they put in place of one adds at most an ``e``, an ``i`` or, after a ``b``, ``le`` (whose
    ``e`` can go again) to what the word had there itself; only words of three letters or more change so.
    """
    out = {lexeme}
    if len(lexeme) > 2:
        if lexeme.endswith(("e", "i", "bl")):
            out.add(lexeme[:-1])
        if lexeme.endswith("ble") and len(lexeme) > 3:
            out.add(lexeme[:-2])
    return out


def ctes(source: str, name: str) -> str:
    """The same as common table expressions for DuckDB: ``name`` (w, lexeme) of the table ``source`` (w)."""
    found = stages(lambda text, pattern: f"regexp_matches({text}, '{pattern}')")
    parts, at = [], source
    for k, (column, sql) in enumerate(found):
        parts.append(f"{name}_{k} AS (SELECT *, {sql} AS {column} FROM {at})")
        at = f"{name}_{k}"
    return ",\n".join([*parts, f"{name} AS (SELECT w, lexeme FROM {at})"])
