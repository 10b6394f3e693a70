"""Text functions as column expressions: they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what they fold to.
QUOTES = "‘’‚‛“”„‟«»‐‑‒–—―− "
FOLDED = "''''\"\"\"\"\"\"------- "
ABSENT = ["", "n/a", "na", "none", "null", "unknown", "not stated", "-"]


# Accented letters and what they fold to.
ACCENTED = "àâäáãçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaceeeeiiiinooooouuuuyy"


#: No ASCII letter, digit or _ before, none after, and a place where one ends or begins.
_NONE_BEFORE, _NONE_AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_BOUND = f"(?:(?<=[0-9A-Za-z_]){_NONE_AFTER}|{_NONE_BEFORE}(?=[0-9A-Za-z_]))"


def ascii_bounds(pattern: str) -> str:
    """A pattern whose ``\\b`` knows ASCII letters alone, as ``\\w`` does: Java's takes an accented letter for a part of the word."""

    def bound(m: re.Match) -> str:
        if m[0] != r"\b":
            return m[0]
        # Beside a letter that has to be there one look is enough.
        if re.match(r"[0-9A-Za-z](?![?*{])", pattern[m.end() :]):
            return _NONE_BEFORE
        return _NONE_AFTER if re.search(r"(?<!\\)[0-9A-Za-z]$", pattern[: m.start()]) else _BOUND

    return re.sub(r"\\.", bound, pattern)


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def source_ref(text: Column, known: Column) -> Column:
    """The one known source that a text refers to (S3, [s3], source 3); NULL for none, or for two that differ."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(ascii_bounds(r"\b(?:s|source )(\d+)\b")), F.lit(1)), lambda n: F.concat(F.lit("S"), n))
    own = F.array_intersect(F.array_distinct(found), known)
    return F.when(F.size(own) == 1, F.get(own, F.lit(0)))


def squeeze(text: Column) -> Column:
    """Horizontal white space to one space, blank lines to one, ends trimmed."""
    one = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return F.trim(one)


def fold(text: Column) -> Column:
    """Quotes, dashes, white space and case folded, for comparing quotations."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, QUOTES, FOLDED), r"\s+", " ")))


def fold_all(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def title_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def line_key(line: Column, most: int = 60) -> Column:
    """A line's key: digits masked where it is short enough to be a running line."""
    key = title_key(line)
    return F.when(F.length(key) <= most, F.regexp_replace(key, r"\d+", "#")).otherwise(key)


def without_lines(text: Column, keys: Column) -> Column:
    """A text without the lines whose key is among ``keys``, blank lines squeezed."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(keys, line_key(x)))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def absent_to_null(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)).isin(ABSENT), None).otherwise(text)


def clause_number(text: Column) -> Column:
    """A dotted number without trailing marks and without leading zeros in its segments."""
    bare = F.regexp_replace(F.trim(text), r"[.:)\s]+$", "")
    return F.array_join(F.transform(F.split(bare, r"\."), lambda s: F.regexp_replace(s, r"^0+(?=\d)", "")), ".")


def clause_depth(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def clause_parent(number: Column) -> Column:
    parts = F.split(number, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))


def clause_under(number: Column, clause: str) -> Column:
    """The clause itself or one below it: 20 takes 20.1 but not 200."""
    return (number == clause) | number.startswith(f"{clause}.")


def natural_key(number: Column) -> Column:
    """Segments as numbers, for ordering dotted numbers; what isn't a number counts as 0."""
    return F.transform(F.split(number, r"\."), lambda s: F.coalesce(s.try_cast("int"), F.lit(0)))


def repair_digits(number: Column) -> Column:
    """Letters read for digits (O, l, I) in segments that hold a digit."""
    fixed = F.transform(F.split(number, r"\."), lambda s: F.when(s.rlike(r"\d"), F.translate(s, "OolIi", "00111")).otherwise(s))
    return F.array_join(fixed, ".")


def roman_value(text: Column) -> Column:
    """The value of a roman numeral, NULL for anything else."""
    # The letters' values by position.
    value = lambda c: F.element_at(F.array(*[F.lit(v) for v in (1, 5, 10, 50, 100, 500, 1000)]), F.position(c, F.lit("IVXLCDM")))
    letters = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    total = F.aggregate(letters, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, c: F.struct((s["sum"] + value(c) - F.when(s["last"] < value(c), 2 * s["last"]).otherwise(0)).alias("sum"), value(c).alias("last")))
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), total["sum"])


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def capital_ratio(text: Column) -> Column:
    """Share of words that begin with a capital, among words of more than three letters."""
    content = F.filter(words(text), lambda w: F.length(w) > 3)
    return F.when(F.size(content) > 0, F.size(F.filter(content, lambda w: w.rlike("^[A-Z]"))) / F.size(content)).otherwise(F.lit(0.0))


def numeric_share(text: Column) -> Column:
    own = words(text)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: w.rlike(r"\d"))) / F.size(own)).otherwise(F.lit(0.0))


def excerpt(text: Column, position: Column, reach: int = 180) -> Column:
    """Text around a position counted from 1, with ellipses where it is cut."""
    start, stop = F.greatest(F.lit(1), position - reach), F.least(F.length(text), position + reach)
    middle = F.trim(text.substr(start, stop - start + 1))
    return F.concat(F.when(start > 1, "…").otherwise(""), middle, F.when(stop < F.length(text), "…").otherwise(""))


def without_label(text: Column) -> Column:
    """A reference without a label such as "Our Ref:"."""
    return F.trim(F.regexp_replace(text, r"(?i)^\s*(our|your)?\s*ref(erence)?\s*(no)?\s*[.:]*\s*", ""))


def safe_filename(name: Column, most: int = 120) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f<>:\"|?*]", "_"), r"^\.+", "")
    return F.when(F.length(clean) == 0, F.lit("file")).otherwise(F.substring(clean, 1, most))


def model_name(name: Column) -> Column:
    """Lower case, without a quantisation suffix, with a tag."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"-q\d[a-z0-9_]*$", "")
    return F.when(bare.contains(":"), bare).otherwise(F.concat(bare, F.lit(":latest")))


def table_text(rows: Column) -> Column:
    """Rows of cells as lines of cells parted by bars; rows without text are dropped."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "))
    return F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"[ |]", "") != ""), "\n")
