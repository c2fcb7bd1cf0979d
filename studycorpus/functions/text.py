"""Text expressions. All of them stay in the JVM.

Unicode normal forms and full case folding come from ICU, which ships with
Spark, through the built-in ``java_method``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as V

# What str.strip() and \s mean for Unicode text. EXOTIC is the part that plain
# blanks, tabs and line ends do not cover; texts without it take the fast way.
EXOTIC = r"\x0b\f\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = rf"[ \t\n\r{EXOTIC}]"
WS_INLINE = rf"[ \t\r{EXOTIC}]"
_EXOTIC_CODES = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                 0x205F, 0x3000]
WS_CHARS = " \t\n\r" + "".join(map(chr, _EXOTIC_CODES))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _icu(cls: str, method: str, c: Column, flag: bool) -> Column:
    # java_method hands the value to Java as it is, so null is made empty first.
    return F.java_method(F.lit(cls), F.lit(method), F.coalesce(c, F.lit("")), F.lit(flag))


def nfkc(c) -> Column:
    return _icu("com.ibm.icu.text.Normalizer", "compose", col(c), True)


def nfc(c) -> Column:
    return _icu("com.ibm.icu.text.Normalizer", "compose", col(c), False)


def nfkd(c) -> Column:
    return _icu("com.ibm.icu.text.Normalizer", "decompose", col(c), True)


def casefold(c) -> Column:
    return _icu("com.ibm.icu.lang.UCharacter", "foldCase", col(c), True)


def unnest(df: DataFrame, keep: list, array, *names: str) -> DataFrame:
    """Explode with positions, empty arrays giving no row.

    The outer form keeps Spark from testing the array in an added filter, which
    would compute a costly array expression a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(*names)).filter(F.col(names[0]).isNotNull())


def let(c, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(col(c)), use), 1)


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def has_exotic(c: Column) -> Column:
    # one wide range is much faster than the exact class; what it holds beyond
    # white space only sends a text the slower, equally right way
    return c.rlike(r"[\x0b\f\x1c-\x1f\x85\u00a0\u1680\u2000-\u3000]")


def collapse(c) -> Column:
    """White space runs become one space, ends are trimmed."""
    return strip(let(c, lambda t: F.when(has_exotic(t), F.regexp_replace(t, f"{WS}+", " "))
                     .otherwise(F.regexp_replace(t, r"[ \t\n\r]{2,}|[\t\n\r]", " "))))


def clean_line(c) -> Column:
    return collapse(F.coalesce(col(c), F.lit("")))


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def _tidied(t: Column) -> Column:
    for old, new in (("\u00a0", " "), ("\r\n", "\n"), ("\r", "\n"), ("\t", " ")):
        t = _swap(t, old, new)
    t = F.regexp_replace(F.regexp_replace(t, " {2,}", " "), rf"{WS_INLINE}*\n{WS_INLINE}*", "\n")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def clean_block(c) -> Column:
    """Tidy white space inside lines and keep at most one blank line in a row.

    One search tells whether there is anything to tidy; most texts only get their
    ends trimmed.
    """
    untidy = r"[\t\r\x0b\f\x1c-\x1f\x85\u00a0\u1680\u2000-\u3000]|  | \n|\n |\n\n\n"
    return strip(let(F.coalesce(col(c), F.lit("")), lambda t: F.when(t.rlike(untidy), _tidied(t)).otherwise(t)))


def norm_compare(c) -> Column:
    """Comparison form of a text: NFKC, lower case, single spaces."""
    return collapse(F.lower(nfkc(c)))


def _unaccent(c: Column) -> Column:
    return F.regexp_replace(nfkd(c), r"\p{Mn}", "")


def fold_section(c) -> Column:
    """Fold of section titles; the barred d keeps its bar."""
    t = F.regexp_replace(F.lower(_unaccent(col(c))), "[_\\-–—]+", " ")
    return collapse(t)


def fold(c) -> Column:
    """Fold of labels and catalog cells; the barred d becomes d."""
    t = F.translate(_unaccent(col(c)), "đĐ", "dD")
    return casefold(collapse(t))


def word_count(c) -> Column:
    return let(F.coalesce(col(c), F.lit("")), lambda t: F.when(has_exotic(t), F.regexp_count(t, F.lit(f"[^{WS[1:]}+")))
               .otherwise(F.regexp_count(t, F.lit(r"\S+"))))


def clean_word_count(c) -> Column:
    """Word count of an already clean text: its separators are single blanks and
    one or two line ends."""
    def count(t):
        single = _swap(t, "\n\n", "\n")
        gaps = F.length(single) - F.length(_swap(_swap(single, " ", ""), "\n", ""))
        return F.when(t == "", 0).when(has_exotic(t), word_count(t)).otherwise(gaps + 1)

    return let(c, count)


def slug(c, max_len: int = 80) -> Column:
    t = F.regexp_replace(F.lower(_unaccent(col(c))), "[^a-z0-9]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.substring(F.when(t == "", "document").otherwise(t), 1, max_len)


def safe_name(c, max_len: int = V.NAME_MAX) -> Column:
    """File name without illegal characters, reserved names or dot/space ends."""
    t = F.regexp_replace(clean_line(c), V.ILLEGAL_NAME_CHARS, "_")
    t = F.regexp_replace(F.regexp_replace(t, f"{WS}+", " "), r"[ .]+\z", "")
    t = F.when(t == "", "untitled").otherwise(t)
    first = F.upper(F.substring_index(t, ".", 1))
    t = F.when(first.isin(*V.RESERVED_NAMES), F.concat(F.lit("_"), t)).otherwise(t)
    t = F.regexp_replace(F.substring(t, 1, max_len), r"[ .]+\z", "")
    return F.when(t == "", "untitled").otherwise(t)


def quoted(c) -> Column:
    """JSON string literal of a value."""
    body = F.to_json(F.struct(F.coalesce(col(c), F.lit("")).alias("v")))
    return F.regexp_extract(body, r'(?s)\A\{"v":(.*)\}\z', 1)


def tokens(c) -> Column:
    """Distinct word tokens, case-folded after the split: a folded letter may gain a
    mark that is no word character."""
    words = F.split(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")), " ")
    # one fold for the whole text: it never makes a blank
    folded = F.split(casefold(F.array_join(F.filter(words, lambda w: w != ""), " ")), " ")
    return F.array_distinct(F.filter(folded, lambda w: w != ""))


# --- paths -------------------------------------------------------------------

def base_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_dir(path) -> Column:
    return F.regexp_extract(col(path), r"\A(.*)/[^/]*\z", 1)


def suffix(path) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)\z", 1))


def stem(path) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+\z", "")


def title_of(path) -> Column:
    name = base_name(path)
    folder = clean_line(base_name(parent_dir(path)))
    plain = clean_line(F.replace(stem(path), F.lit("_"), F.lit(" ")))
    return (F.when(F.lower(name).isin(*V.CONTENT_NAMES),
                   F.when(folder != "", folder).otherwise(stem(path)))
             .otherwise(F.when(plain != "", plain).otherwise(name)))


def is_absolute(path) -> Column:
    p = F.coalesce(col(path), F.lit(""))
    return (p != "") & (p.startswith("/") | p.rlike(V.ABSOLUTE_PATH))


def has_parent_step(path) -> Column:
    return F.array_contains(F.split(F.coalesce(col(path), F.lit("")), "/"), "..")


# --- ids ---------------------------------------------------------------------

def source_id(path, source_type) -> Column:
    key = F.concat_ws("|", col(path), col(source_type))
    return F.concat(F.lit("src_"), F.substring(F.sha1(key), 1, 12))


def snapshot_id(path) -> Column:
    return F.substring(F.sha2(col(path), 256), 1, 20)


# --- course codes ------------------------------------------------------------

def course_code(name) -> Column:
    """Code found in a display name, null when there is none."""
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(col(name), F.lit("")), V.COURSE_CODE, 1)), F.lit(""))


def catalog_code(value) -> Column:
    """Code of a catalog cell, empty when there is none."""
    packed = F.upper(F.regexp_replace(F.coalesce(col(value), F.lit("")), "[^A-Za-z0-9]", ""))
    return F.regexp_extract(packed, f"({V.CATALOG_CODE})", 1)


def catalog_name_key(value) -> Column:
    t = F.regexp_replace(fold(value), V.CATALOG_NAME_TAIL, "")
    return collapse(F.regexp_replace(t, "[^a-z0-9]+", " "))


def any_contains(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])
