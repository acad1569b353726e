"""Sound codes and difference ratios of names: Arrow UDFs, since Spark has neither built in.

They are given distinct names or pairs, so each is worked out once. Names are normalised (text.normalize) by the caller.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X

# The published rules of Double Metaphone. Of a letter's rules the first holds whose text ahead (from the
# letter on; a blank ends the word) and text before match; each gives the primary and, if other, the secondary sound
# and the letters passed over. "slavic" rules ask that the word has W, K, CZ or WITZ, "other" ones that it has not.
_VOWEL = "[AEIOUY]"
_GERMAN = "^(?:VAN |VON |SCH)"
_RULES: dict[str, list[tuple]] = {
    "B": [("BB?", "", "", "P")],
    "C": [
        ("CH(?:[^IE]|E(?=R))", "(?:^|[^AEIOUY])[^AEIOUY]A$", "", "K", "K", 2),
        ("CAESAR", "^$", "", "S", "S", 2), ("CHIA", "", "", "K", "K", 2), ("CHAE", ".", "", "K", "X", 2),
        ("CH(?:ARAC|ARIS|OR(?!E)|YM|IA|EM)", "^$", "", "K", "K", 2),
        ("CH", _GERMAN, "", "K", "K", 2), ("CH(?=ES|IT|ID)", "(?:OR|AR)$", "", "K", "K", 2), ("CH[TS]", "", "", "K", "K", 2), ("CH[LRNMBHFVW ]", "(?:^|[AOUE])$", "", "K", "K", 2),
        ("CH", "^MC", "", "K", "K", 2), ("CH", ".", "", "X", "K", 2), ("CH", "", "", "X", "X", 2),
        ("CZ", "(?<!WI)$", "", "S", "X", 2), ("CCIA", "", "", "X", "X", 3),
        ("CC(?=[IEH])(?!CHU)", "^A$", "", "KS", "KS", 3), ("CCE[ES]", "U$", "", "KS", "KS", 3), ("CC[IEH](?<!HU)", "(?<!^M)$", "", "X", "X", 3), ("CC", "(?<!^M)$", "", "K", "K", 2),
        ("C[KGQ]", "", "", "K", "K", 2), ("CI[OEA]", "", "", "S", "X", 2), ("C[IEY]", "", "", "S", "S", 2), ("C [CQG]", "", "", "K", "K", 3), ("C[CKQ](?![EI])", "", "", "K", "K", 2), ("C", "", "", "K"),
    ],
    "D": [("DG[IEY]", "", "", "J", "J", 3), ("DG", "", "", "TK", "TK", 2), ("D[TD]", "", "", "T", "T", 2), ("D", "", "", "T")],
    "F": [("FF?", "", "", "F")],
    "G": [
        ("GH", "[^AEIOUY]$", "", "K", "K", 2), ("GHI", "^$", "", "J", "J", 2), ("GH", "^$", "", "K", "K", 2),
        ("GH", "(?:[BHD].|[BHD]..|[BH]...)$", "", "", "", 2), ("GH", "[CGLRT].U$", "", "F", "F", 2), ("GH", "[^I]$", "", "K", "K", 2), ("GH", "", "", "", "", 2),
        ("GN", f"^{_VOWEL}$", "other", "KN", "N", 2), ("GN(?!EY)", "", "other", "N", "KN", 2), ("GN", "", "", "KN", "KN", 2), ("GLI", "", "other", "KL", "L", 2),
        ("G(?:Y|ES|EP|EB|EL|EY|IB|IL|IN|IE|EI|ER)", "^$", "", "K", "J", 2), ("G(?:ER|Y)", "(?<!^DAN)(?<!^RAN)(?<!^MAN)(?<![EI])$", "", "K", "J", 2),
        ("G[EIY]", _GERMAN, "", "K", "K", 2), ("GET", "", "", "K", "K", 2), ("GIER ", "", "", "J", "J", 2), ("G[EIY]", "", "", "J", "K", 2), ("GGI", "[AO]$", "", "J", "K", 2), ("GG?", "", "", "K"),
    ],
    "H": [(f"H{_VOWEL}", f"(?:^|{_VOWEL})$", "", "H", "H", 2), ("H", "", "", "")],
    "J": [
        ("JOSE ", "^$", "", "H", "H", 1), ("J", "^SAN ", "", "H", "H", 1), ("JOSE", "", "", "J", "H", 1), ("JJ?", "^$", "", "J", "A"), ("JJ?(?=[AO])", f"{_VOWEL}$", "other", "J", "H"),
        ("J ", "", "", "J", "", 1), ("JJ?(?![LTKSNMBZ])", "(?<![SKL])$", "", "J"), ("JJ?", "", "", ""),
    ],
    "K": [("KK?", "", "", "K")],
    "L": [("LL(?=[OA] )", "I$", "", "L", "", 2), ("LL(?=E )", "A$", "", "L", "", 2), ("LL?", "", "", "L")],
    "M": [("MB(?: |ER)", "U$", "", "M", "M", 2), ("MM?", "", "", "M")],
    "N": [("NN?", "", "", "N")],
    "P": [("PH", "", "", "F", "F", 2), ("P[PB]?", "", "", "P")],
    "Q": [("QQ?", "", "", "K")],
    "R": [("R ", "(?<!M[EA])IE$", "other", "", "R", 1), ("RR?", "", "", "R")],
    "S": [
        ("S(?=L)", "[IY]$", "", ""), ("SUGAR", "^$", "", "X", "S", 1), ("SH(?:EIM|OEK|OLM|OLZ)", "", "", "S", "S", 2), ("SH", "", "", "X", "X", 2), ("SI[OA]", "", "other", "S", "X", 3), ("SI[OA]", "", "", "S", "S", 3),
        ("S[MNLW]", "^$", "", "S", "X", 1), ("SZ", "", "", "S", "X", 2), ("SCH(?:ER|EN)", "", "", "X", "SK", 3), ("SCH(?:OO|UY|ED|EM)", "", "", "SK", "SK", 3), ("SCH[^AEIOUYW]", "^$", "", "X", "S", 3), ("SCH", "", "", "X", "X", 3),
        ("SC[IEY]", "", "", "S", "S", 3), ("SC", "", "", "SK", "SK", 3), ("S ", "[AO]I$", "", "", "S", 1), ("S[SZ]?", "", "", "S"),
    ],
    "T": [("TI(?:ON|A)", "", "", "X", "X", 3), ("TCH", "", "", "X", "X", 3), ("TT?H[OA]M", "", "", "T", "T", 2), ("TT?H", _GERMAN, "", "T", "T", 2), ("TT?H", "", "", "0", "T", 2), ("T[TD]?", "", "", "T")],
    "V": [("VV?", "", "", "F")],
    "W": [
        ("WR", "", "", "R", "R", 2), (f"W{_VOWEL}", "^$", "", "A", "F", 1), ("WH", "^$", "", "A", "A", 1), ("W ", f"{_VOWEL}$", "", "", "F", 1), ("WSK[IY]", "[EO]$", "", "", "F", 1), ("W", "^SCH", "", "", "F", 1),
        ("W(?:ICZ|ITZ)", "", "", "TS", "FX", 4), ("W", "", "", ""),
    ],
    "X": [("X ", "(?:[IE]AU|[AO]U)$", "", "", "", 1), ("X[CX]?", "", "", "KS")],
    "Z": [("ZH", "", "", "J", "J", 2), ("ZZ?(?=[OIA])", "", "", "S", "TS"), ("ZZ?", "[^T]$", "slavic", "S", "TS"), ("ZZ?", "", "", "S")],
}
_COMPILED = {c: [(re.compile(r[0]), re.compile(r[1]), *r[2:]) for r in rules] for c, rules in _RULES.items()}


@lru_cache(100_000)
def double_metaphone(name: str, length: int = 4) -> tuple[str, str]:
    """Primary and secondary sound code of a name of ASCII letters, each cut to `length`; the secondary may equal it."""
    word = re.sub("[^A-Z ]", "", name.upper()).strip()
    slavic = bool(re.search("W|K|CZ|WITZ", word))
    one, two = "", ""
    at = 1 if re.match("GN|KN|PN|WR|PS", word) else 0
    if word.startswith("X"):
        one = two = "S"
        at = 1
    ahead = word + "     "
    while at < len(word) and (len(one) < length or len(two) < length):
        c = word[at]
        if c in "AEIOUY":
            if at == 0:
                one, two = one + "A", two + "A"
            at += 1
            continue
        step = 1
        for rule in _COMPILED.get(c, ()):
            met = rule[0].match(ahead, at)
            if met and rule[1].search(word[:at]) and (not rule[2] or (rule[2] == "slavic") == slavic):
                one += rule[3]
                two += rule[4] if len(rule) > 4 else rule[3]
                step = rule[5] if len(rule) > 5 else max(1, len(met[0].rstrip()))
                break
        at += step
    return one[:length], two[:length]


@F.pandas_udf(T.StructType([T.StructField("primary", T.StringType()), T.StructField("secondary", T.StringType())]))
def sound_codes(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([double_metaphone(n or "") for n in names], columns=["primary", "secondary"])


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def difference_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters of both."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


_VOICED = str.maketrans("dbgvz", "tpkfs")


def first_syllable(word: str) -> str:
    """Up to the first consonant behind the first vowel."""
    return re.match("[^aeiouy]*[aeiouy]*[^aeiouy]?", word)[0]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sounds_alike(a: str, b: str) -> float:
    """Similarity of two compact names by sound: codes shared, edits of codes, voiced and unvoiced letters, first syllables."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    p, q = double_metaphone(a, 64), double_metaphone(b, 64)
    x, y = set(filter(None, p)), set(filter(None, q))
    shared = len(x & y) / len(x | y) if x and y else 0.0
    codes = 1 - _edits(p[0], q[0]) / max(len(p[0]), len(q[0])) if p[0] and q[0] else 0.0
    voices = ratio(a.translate(_VOICED), b.translate(_VOICED))
    s, t = first_syllable(a), first_syllable(b)
    return round(min(1.0, 0.25 * shared + 0.35 * codes + 0.25 * voices + 0.15 * (1.0 if s == t else ratio(s, t))), 4)


@F.pandas_udf(T.DoubleType())
def _sound_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sounds_alike(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def sound_similarity(a: Column, b: Column) -> Column:
    return _sound_similarity(X.compact(a), X.compact(b))


@F.pandas_udf(T.DoubleType())
def _ocr(a: pd.Series, b: pd.Series) -> pd.Series:
    def score(x: str, y: str) -> float:
        p, q = x.replace(" ", ""), y.replace(" ", "")
        if not p or not q:
            return 0.0
        if p == q:
            return 1.0
        best = max(ratio(x, y), ratio(p, q))
        short, long = sorted((len(p), len(q)))
        return round(min(best, 0.68 if short <= 5 else 1.0, 0.62 if short / long < 0.60 else 1.0), 4)

    return pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def ocr_similarity(a: Column, b: Column) -> Column:
    """Of two texts read from logos: 1 if equal but for blanks, else the difference ratio, capped for short ones and fragments."""
    return _ocr(X.normalize(a), X.normalize(b))
