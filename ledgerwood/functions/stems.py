"""English stems (the Porter2 rules of Snowball) as column expressions, and their SQL. No Python worker.

A word is lower case without accents. R1 is what follows the first consonant after a vowel, R2 the same within
R1; most endings go only where they lie in one of them. An expression is bound once by ``_let``, so that each
step sees the word, and not the whole tree of steps before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with stems of their own, words that stay, and the endings of each step with what follows them.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
WHOLE = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
# Words that a search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()

_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    # One step of a fold: taking the item of a list works out its type for each word, through all that is bound within.
    return F.aggregate(F.array(value), F.lit(""), lambda _, v: then(v))


def _any(endings) -> str:
    return f"({'|'.join(endings)})$"


def _ending(w: Column, endings) -> Column:
    """The ending that a word has, or an empty string. Few words have one: their last two letters tell most of the others without a pattern."""
    return F.when(F.substring(w, -2, 2).isin(sorted({e[-2:] for e in endings})), F.regexp_extract(w, _any(endings), 1)).otherwise(F.lit(""))


def _cut(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _plural(w: Column) -> Column:
    return (
        F.when(~(w.endswith("s") | w.endswith("ied")), w).when(w.endswith("sses"), _cut(w, 2)).when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when(w.rlike("[us]s$"), w).when(w.rlike("[aeiouy].+s$"), _cut(w, 1)).otherwise(w)
    )


def _past(w: Column, p1: Column) -> Column:
    def mended(s: Column) -> Column:
        short = (F.length(s) == p1) & s.rlike(_SHORT)
        return F.when(s.rlike("(at|bl|iz)$") | short, F.concat(s, F.lit("e"))).when(s.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(s, 1)).otherwise(s)

    def step(e: Column) -> Column:
        stem = _cut(w, F.length(e))
        eed = F.when(F.length(stem) >= p1, F.concat(stem, F.lit("ee"))).otherwise(w)
        return F.when(e == "", w).when(e.startswith("eed"), eed).when(stem.rlike("[aeiouy]"), _let(stem, mended)).otherwise(w)

    return _let(_ending(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]), step)


def _second(w: Column, p1: Column) -> Column:
    def step(e: Column) -> Column:
        stem = _cut(w, F.length(e))
        ok = (F.length(stem) >= p1) & F.when(e == "ogi", stem.endswith("l")).when(e == "li", stem.rlike("[cdeghkmnrt]$")).otherwise(F.lit(True))
        return F.when((e != "") & ok, F.concat(stem, F.try_element_at(_map(SECOND), e))).otherwise(w)

    return _let(_ending(w, SECOND), step)


def _third(w: Column, p1: Column, p2: Column) -> Column:
    def step(e: Column) -> Column:
        stem = _cut(w, F.length(e))
        ok = (F.length(stem) >= p1) & ((e != "ative") | (F.length(stem) >= p2))
        return F.when((e != "") & ok, F.concat(stem, F.try_element_at(_map(THIRD), e))).otherwise(w)

    return _let(_ending(w, THIRD), step)


def _fourth(w: Column, p2: Column) -> Column:
    def step(e: Column) -> Column:
        stem = _cut(w, F.length(e))
        return F.when((e != "") & (F.length(stem) >= p2) & ((e != "ion") | stem.rlike("[st]$")), stem).otherwise(w)

    return _let(_ending(w, FOURTH), step)


def _last(w: Column, p1: Column, p2: Column) -> Column:
    n, stem = F.length(w) - 1, _cut(w, 1)
    e = w.endswith("e") & ((n >= p2) | ((n >= p1) & ~stem.rlike(_SHORT)))
    return F.when(e | (w.endswith("ll") & (n >= p2)), stem).otherwise(w)


def english(word: Column) -> Column:
    """The stem of a lower-case word; words of up to two letters, and those that aren't letters, stay."""

    def regions(w: Column) -> Column:
        p1 = F.when(w.startswith("gener") | w.startswith("arsen"), F.lit(5)).when(w.startswith("commun"), F.lit(6)).otherwise(F.length(F.regexp_extract(w, f"({_REGION})", 1)))
        return _let(p1, lambda a: _let(F.when(a > 0, a).otherwise(F.length(w)), lambda b: within(w, b)))

    def within(w: Column, p1: Column) -> Column:
        more = F.length(F.regexp_extract(F.substring(w, p1 + 1, F.length(w)), f"({_REGION})", 1))
        return _let(more, lambda a: _let(F.when(a > 0, p1 + a).otherwise(F.length(w)), lambda p2: steps(w, p1, p2)))

    def steps(w: Column, p1: Column, p2: Column) -> Column:
        rest = lambda a: _let(_past(a, p1), lambda b: _let(F.when(F.lower(b).endswith("y"), F.regexp_replace(b, "^(.+[^aeiouy])[yY]$", "$1i")).otherwise(b), lambda c: _let(_second(c, p1), lambda d: _let(_third(d, p1, p2), lambda e: _let(_fourth(e, p2), lambda f: _last(f, p1, p2))))))
        return _let(_plural(w), lambda a: F.when(a.isin(WHOLE), a).otherwise(rest(a)))

    def marked(w: Column) -> Column:
        return F.when(w.contains("y"), F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")).otherwise(w)

    stem = F.translate(_let(marked(word), regions), "Y", "y")
    return F.when(word.isin(list(IRREGULAR)), F.try_element_at(_map(IRREGULAR), word)).when((F.length(word) <= 2) | ~word.rlike("^[a-z]+$"), word).otherwise(stem)


def _cases(values: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def stems_sql(words: str, into: str = "stems") -> str:
    """Common table expressions from a relation ``words`` (word) to ``into`` (word, stem)."""
    irregular = ", ".join(f"'{w}'" for w in IRREGULAR)
    whole = ", ".join(f"'{w}'" for w in WHOLE)
    region = "[^aeiouy]*[aeiouy]+[^aeiouy]"
    carry = "word, p1, p2"
    return f"""
s0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}),
s1 AS (SELECT word, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN regexp_matches(w, '^{region}') THEN length(regexp_extract(w, '^{region}')) ELSE length(w) END AS p1 FROM s0),
s2 AS (SELECT word, w, p1, CASE WHEN regexp_matches(substr(w, p1 + 1), '^{region}') THEN p1 + length(regexp_extract(substr(w, p1 + 1), '^{region}')) ELSE length(w) END AS p2 FROM s1),
s3 AS (SELECT {carry}, CASE WHEN ends_with(w, 'sses') THEN w[:-3] WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w FROM s2),
s4 AS (SELECT {carry}, w, w IN ({whole}) AS done, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM s3),
s5 AS (SELECT {carry}, w, done, e, left(w, length(w) - length(e)) AS t FROM s4),
s6 AS (SELECT {carry}, done, CASE WHEN done OR e = '' THEN w WHEN starts_with(e, 'eed') THEN CASE WHEN length(t) >= p1 THEN t || 'ee' ELSE w END WHEN NOT regexp_matches(t, '[aeiouy]') THEN w
  WHEN regexp_matches(t, '(at|bl|iz)$') OR (length(t) = p1 AND regexp_matches(t, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')) THEN t || 'e' WHEN regexp_matches(t, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN t[:-2] ELSE t END AS w FROM s5),
s7 AS (SELECT {carry}, done, CASE WHEN done THEN w ELSE regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') END AS w FROM s6),
s8 AS (SELECT *, regexp_extract(w, '({"|".join(SECOND)})$') AS e FROM s7),
s9 AS (SELECT {carry}, done, CASE WHEN done OR e = '' OR length(w) - length(e) < p1 OR (e = 'ogi' AND NOT ends_with(w, 'logi')) OR (e = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$')) THEN w ELSE left(w, length(w) - length(e)) || {_cases(SECOND)} END AS w FROM s8),
s10 AS (SELECT *, regexp_extract(w, '({"|".join(THIRD)})$') AS e FROM s9),
s11 AS (SELECT {carry}, done, CASE WHEN done OR e = '' OR length(w) - length(e) < p1 OR (e = 'ative' AND length(w) - 5 < p2) THEN w ELSE left(w, length(w) - length(e)) || {_cases(THIRD)} END AS w FROM s10),
s12 AS (SELECT *, regexp_extract(w, '({"|".join(FOURTH)})$') AS e FROM s11),
s13 AS (SELECT {carry}, done, CASE WHEN done OR e = '' OR length(w) - length(e) < p2 OR (e = 'ion' AND NOT regexp_matches(w, '[st]ion$')) THEN w ELSE left(w, length(w) - length(e)) END AS w FROM s12),
s14 AS (SELECT {carry}, CASE WHEN done THEN w WHEN ends_with(w, 'e') AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT regexp_matches(w[:-2], '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'))) THEN w[:-2] WHEN ends_with(w, 'll') AND length(w) - 1 >= p2 THEN w[:-2] ELSE w END AS w FROM s13),
{into} AS (SELECT word, CASE WHEN word IN ({irregular}) THEN {_cases(IRREGULAR).replace("CASE e", "CASE word")} WHEN length(word) <= 2 OR NOT regexp_matches(word, '^[a-z]+$') THEN word ELSE replace(w, 'Y', 'y') END AS stem FROM s14)"""
