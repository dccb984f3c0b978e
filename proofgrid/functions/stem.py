"""The Porter stemmer with the extensions common in text scoring, as column expressions.

Words are lower case. Vowels are a, e, i, o, u, and y after a consonant; the measure m
counts vowel-consonant sequences. Every step is a regular expression and a lookup, so a
whole vocabulary is stemmed inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published suffix rules and word list.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

V, C = "[aeiouy]", "[^aeiouy]"
HAS_VOWEL = V
M_OVER_0 = f"^{C}*{V}+{C}"
M_OVER_1 = f"^{C}*{V}+{C}+{V}+{C}"
M_IS_1 = f"^{C}*{V}+{C}+{V}*$"
CVC = f"({C}{V}[^aeiouywxY]|^{V}{C})$"


def _shape(word: Column) -> Column:
    """The word with each consonant y in upper case."""
    after_vowel = F.regexp_replace(word, "(^|[aeiou])y", "$1Y")
    return F.regexp_replace(after_vowel, "yy", "yY")


def _has(stem: Column, pattern: str) -> Column:
    return _shape(stem).rlike(pattern)


def _ends(word: Column, suffix: str) -> Column:
    return word.endswith(suffix)


def _drop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _longest(suffixes) -> str:
    return "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))


def _lookup(value: Column, table: dict[str, str]) -> Column:
    cells = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*cells), value)


def _replace_suffix(word: Column, table: dict[str, str], pattern: str) -> Column:
    """The longest listed suffix decides; it changes only if the rest has the measure."""
    rule = f"({_longest(table)})$"
    suffix = F.regexp_extract(word, rule, 1)
    rest = F.substring(word, F.lit(1), F.length(word) - F.length(suffix))
    changes = (suffix != "") & _has(rest, pattern)
    return F.when(changes, F.concat(rest, _lookup(suffix, table))).otherwise(word)


def _plurals(w: Column) -> Column:
    return (
        F.when(_ends(w, "ies") & (F.length(w) == 4), _drop(w, 1))
        .when(_ends(w, "sses") | _ends(w, "ies"), _drop(w, 2))
        .when(_ends(w, "s") & ~_ends(w, "ss"), _drop(w, 1))
        .otherwise(w)
    )


def _participle_base(w: Column) -> Column:
    """The word without ed or ing if a vowel stays; null if the rule does not apply."""
    ed, ing = _drop(w, 2), _drop(w, 3)
    return (
        F.when(_ends(w, "ied") | _ends(w, "eed"), F.lit(None))
        .when(_ends(w, "ed") & _has(ed, HAS_VOWEL), ed)
        .when(_ends(w, "ing") & _has(ing, HAS_VOWEL), ing)
    )


def _mended(base: Column) -> Column:
    doubled = (F.right(base, F.lit(1)) == F.substring(base, -2, 1)) & (F.length(base) >= 2)
    double_consonant = doubled & _has(base, f"{C}$")
    return (
        F.when(_ends(base, "at") | _ends(base, "bl") | _ends(base, "iz"), F.concat(base, F.lit("e")))
        .when(double_consonant, F.when(base.rlike("[lsz]$"), base).otherwise(_drop(base, 1)))
        .when(_has(base, M_IS_1) & _has(base, CVC), F.concat(base, F.lit("e")))
        .otherwise(base)
    )


def _past(w: Column, base: Column, mended: Column) -> Column:
    return (
        F.when(_ends(w, "ied"), F.when(F.length(w) == 4, _drop(w, 1)).otherwise(_drop(w, 2)))
        .when(_ends(w, "eed"), F.when(_has(_drop(w, 3), M_OVER_0), _drop(w, 1)).otherwise(w))
        .when(base.isNotNull(), mended)
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    turns = _ends(w, "y") & (F.length(w) > 2) & _has(_drop(w, 1), f"{C}$")
    return F.when(turns, F.concat(_drop(w, 1), F.lit("i"))).otherwise(w)


def _drop_alli(w: Column) -> Column:
    return F.when(_ends(w, "alli") & _has(_drop(w, 4), M_OVER_0), _drop(w, 2)).otherwise(w)


def _step_2(w: Column) -> Column:
    logi = F.when(_has(_drop(w, 3), M_OVER_0), _drop(w, 1)).otherwise(w)
    return F.when(_ends(w, "logi"), logi).otherwise(_replace_suffix(w, STEP_2, M_OVER_0))


def _step_4(w: Column) -> Column:
    suffix = F.regexp_extract(w, f"({_longest(STEP_4)})$", 1)
    rest = F.substring(w, F.lit(1), F.length(w) - F.length(suffix))
    drops = (suffix != "") & _has(rest, M_OVER_1) & ((suffix != "ion") | rest.rlike("[st]$"))
    return F.when(drops, rest).otherwise(w)


def _final_e(w: Column) -> Column:
    rest = _drop(w, 1)
    drops = _ends(w, "e") & (_has(rest, M_OVER_1) | (_has(rest, M_IS_1) & ~_has(rest, CVC)))
    return F.when(drops, rest).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(_ends(w, "ll") & _has(_drop(w, 1), M_OVER_1), _drop(w, 1)).otherwise(w)


def stemmed(vocabulary: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Add the stem of each word; one projection per step keeps the expressions small."""
    w = F.col("_w")
    steps = vocabulary.withColumn("_w", F.col(word)).withColumn("_w", _plurals(w))
    steps = steps.withColumn("_base", _participle_base(w)).withColumn("_mended", _mended(F.col("_base")))
    steps = steps.withColumn("_w", _past(w, F.col("_base"), F.col("_mended")))
    rules = (_final_y, _drop_alli, _step_2, lambda c: _replace_suffix(c, STEP_3, M_OVER_0), _step_4, _final_e, _final_l)
    for rule in rules:
        steps = steps.withColumn("_w", rule(w))
    known = _lookup(F.col(word), IRREGULAR)
    short = F.when(F.length(word) <= 2, F.col(word))
    return steps.withColumn(out, F.coalesce(known, short, w)).drop("_w", "_base", "_mended")


def _starts(word: str, n: int) -> str:
    """The word without its last ``n`` letters."""
    return word[: max(len(word) - n, 0)]


def _fits(word: str, pattern: str) -> bool:
    shape = re.sub("yy", "yY", re.sub("(^|[aeiou])y", r"\1Y", word))
    return re.search(pattern, shape) is not None


def _without_suffix(word: str, suffixes, pattern: str) -> tuple[str, str]:
    """The word's beginning and its longest listed suffix if the beginning has the measure, else the word and nothing."""
    found = re.search(f"({_longest(suffixes)})$", word)
    if found and _fits(word[: found.start()], pattern):
        return word[: found.start()], found[0]
    return word, ""


def _mended_word(base: str) -> str:
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) >= 2 and base[-1] == base[-2] and _fits(base, f"{C}$"):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _fits(base, M_IS_1) and _fits(base, CVC) else base


def _past_word(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _fits(w[:-3], M_OVER_0) else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _fits(_starts(w, len(suffix)), HAS_VOWEL):
            return _mended_word(_starts(w, len(suffix)))
    return w


def stem_of(word: str) -> str:
    """The stem that ``stemmed`` gives a word, for work that has its words at hand."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    w = word
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = _past_word(w)
    if w.endswith("y") and len(w) > 2 and _fits(w[:-1], f"{C}$"):
        w = w[:-1] + "i"
    if w.endswith("alli") and _fits(w[:-4], M_OVER_0):
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _fits(w[:-3], M_OVER_0) else w
    else:
        rest, suffix = _without_suffix(w, STEP_2, M_OVER_0)
        w = rest + STEP_2.get(suffix, "")
    rest, suffix = _without_suffix(w, STEP_3, M_OVER_0)
    w = rest + STEP_3.get(suffix, "")
    rest, suffix = _without_suffix(w, STEP_4, M_OVER_1)
    if suffix != "ion" or rest.endswith(("s", "t")):
        w = rest
    rest = _starts(w, 1)
    if w.endswith("e") and (_fits(rest, M_OVER_1) or _fits(rest, M_IS_1) and not _fits(rest, CVC)):
        w = rest
    return w[:-1] if w.endswith("ll") and _fits(w[:-1], M_OVER_1) else w
