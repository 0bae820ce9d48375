"""Scalar functions of headings and lines, as column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that a heading's numbering may begin with, and those before a number that make it a date.
LABELS = "item|mục|muc|chương|chuong|phần|phan|điều|dieu|section|part"
DATES = "tháng|thang|năm|nam|ngày|ngay|quý|quy|month|year"
NUMBERING = rf"(?i)^\s*(?:(?:{LABELS})\s+(?:\d+(?:\.\d+)*|[IVXLC]+)\s*[.:)\-–]?\s+|\d+(?:\.\d+)*(?:[.:)\-–]\s+|\s+)|(?:[a-zA-Z]|[IVXLC]+)[.)]\s+)"
ROMAN = "^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
#: What the letters of a roman numeral add, and what the subtractive pairs take away again.
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000, "IV": -2, "IX": -2, "XL": -20, "XC": -20, "CD": -200, "CM": -200}


def repeat_key(text: Column) -> Column:
    """The key that running heads are compared by: lower case, no dot leaders, no number at the end, digits as #."""
    s = F.regexp_replace(F.lower(text), r"(?:\s*[.·…]){2,}", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+\d+$", ""), r"\d", "#"))


def heading_name(text: Column) -> Column:
    """A heading without its numbering and closing punctuation, in lower case and with single spaces."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), NUMBERING, ""), r"[.:;, \t]+$", "")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def heading_key(text: Column) -> Column:
    """The name with dates as #, so that the headings of monthly reports are equal."""
    s = F.regexp_replace(heading_name(text), rf"\b({DATES})\s+\d+(?:\s*/\s*\d+)*", "$1 #")
    return F.regexp_replace(s, r"\b\d{1,2}\s*/\s*\d{4}\b", "#")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def roman_value(s: Column) -> Column:
    """The value of a canonical roman numeral; null for anything else."""
    count = lambda part: (F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)
    total = sum((count(k) * v for k, v in ROMAN_VALUES.items()), F.lit(0))
    return F.when(s.rlike(ROMAN) & (F.length(s) > 0), total.cast("int"))


def sequence_key(text: Column, most_prefix: int = 3) -> Column:
    """(key, value, form) of the first number among the first words, the words before it and the punctuation after it; null
    without one. A roman numeral needs a word before it or punctuation after it."""
    words = F.filter(F.split(F.regexp_replace(F.trim(text), r"^(?:[^\p{L}\p{N}\s]+\s+)+", ""), r"\s+"), lambda w: w != "")

    def read(x: Column, i: Column) -> Column:
        """A number if the word is one; x has the word without opening brackets, and that without closing punctuation."""
        suffix = F.substr(x["token"], F.length(x["core"]) + 1)
        decimal = x["core"].rlike(r"^\d{1,4}$")
        value = F.when(decimal, F.when(decimal, x["core"]).cast("int")).when(((i > 0) | (x["token"] != x["core"])) & x["core"].rlike("^[IVXLCDM]+$"), roman_value(x["core"]))
        return F.struct(i.alias("at"), suffix.alias("suffix"), value.alias("value"), F.when(decimal, F.lit("decimal")).otherwise(F.lit("roman")).alias("form"))

    def first(all_: Column) -> Column:
        token = F.transform(F.slice(all_, 1, most_prefix + 1), lambda w: F.regexp_replace(w, r"^\(+", ""))
        parts = F.transform(token, lambda t: F.struct(t.alias("token"), F.regexp_replace(t, r"[.:);,]+$", "").alias("core")))
        return let(F.get(F.filter(F.transform(parts, read), lambda x: x["value"].isNotNull()), F.lit(0)), lambda x: named(all_, x))

    def named(all_: Column, x: Column) -> Column:
        key = F.concat(F.when(x["at"] > 0, F.concat(F.array_join(F.slice(all_, F.lit(1), x["at"]), " "), F.lit(" "))).otherwise(F.lit("")), F.lit("#"), x["suffix"])
        return F.when(x.isNotNull(), F.struct(key.alias("key"), x["value"].alias("value"), x["form"].alias("form")))

    return let(words, first)


def marker(text: Column) -> Column:
    """(name, rank, number) of the marker that a line begins with; the first rule that matches counts; null without one."""
    found = [F.struct(F.lit(n).alias("name"), F.lit(r).alias("rank"), F.regexp_extract(text, p, 1).alias("number")) for n, r, p in MARKERS]
    out = F.when(text.rlike(MARKERS[0][2]), found[0])
    for (_, _, pattern), value in zip(MARKERS[1:], found[1:], strict=True):
        out = out.when(text.rlike(pattern), value)
    return out


#: Kinds of markers, their ranks, and what they look like, in the order in which they are tried.
MARKERS = (
    ("part", 0, r"^\s*(?:PHẦN|Phần)\s+(?:thứ\s+)?([IVXLCM]+|\d+)(?:$|[^\w])"),
    ("chapter", 1, r"^\s*(?:CHƯƠNG|Chương)\s+([IVXLCM]+|\d+)(?:$|[^\w])"),
    ("section", 2, r"^\s*(?:MỤC|Mục)\s+(\d+)(?:$|[^\w])"),
    ("subsection", 3, r"^\s*(?:TIỂU MỤC|Tiểu mục)\s+(\d+)(?:$|[^\w])"),
    ("article", 4, r"^\s*(?:ĐIỀU|Điều)\s+(\d+)\s*[\.:]?\s"),
    ("roman", 5, r"^\s*([IVXLCM]+)\s*[\.\)]\s*\S"),
    ("path", 7, r"^\s*(\d{1,2}(?:\.\d{1,2})+)\s*\.?\s"),
    ("number", 6, r"^\s*(\d{1,2})\s*[\.\)](?!\d)"),
    ("letter", 8, r"^\s*([aăâbcdđeêghiklmnoôơpqrstuưvxy])\s*[\.\)]\s"),
    ("bullet", 9, r"^\s*([-+*•])\s+\S"),
)


def compact(text: Column) -> Column:
    """Without white space and in lower case, as lines are compared that may be broken elsewhere."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def skeleton(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def label_kind(text: Column) -> Column:
    """The shape of a label: digits as #, runs of capitals as A, runs of other letters as a."""
    digits = F.regexp_replace(text, r"\p{N}+", "#")
    return F.regexp_replace(F.regexp_replace(digits, r"\p{Ll}+", "a"), r"\p{Lu}+", "A")


def leading_token(text: Column) -> Column:
    """The first word, without what closes it; empty for a blank line."""
    return F.regexp_extract(text, r"^\s*(\S*?)[.,:;)]*(?:\s|$)", 1)


def ending_punctuation(text: Column) -> Column:
    """The punctuation that the text ends with; empty without any."""
    return F.regexp_extract(text, r"([.,:;!?…]+)[\s\"'”’)]*$", 1)


def heading_label(text: Column) -> Column:
    """The label and number of a labelled heading, as "điều 5" or "chương iv"; null without one."""
    found = F.regexp_extract(F.lower(text), r"^\s*(chương|mục|điều|phần)\s+([ivxlcdm]+|\d+)(?:$|[^\p{L}\p{N}_])", 0)
    return F.when(found != "", F.trim(F.regexp_replace(F.regexp_replace(found, r"[^\p{L}\p{N}]+$", ""), r"\s+", " ")))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def roman(n: Column) -> Column:
    """A number from 1 to 3999 as a roman numeral; null for others."""
    digit = lambda k: F.floor(n / k).cast("int") % 10
    forms = lambda one, five, ten: F.array(*map(F.lit, ("", one, 2 * one, 3 * one, one + five, five, five + one, five + 2 * one, five + 3 * one, one + ten)))
    parts = [F.get(forms("M", "", ""), digit(1000)), F.get(forms("C", "D", "M"), digit(100)), F.get(forms("X", "L", "C"), digit(10)), F.get(forms("I", "V", "X"), digit(1))]
    return F.when(n.between(1, 3999), F.concat(*parts))


def letters(n: Column) -> Column:
    """A number as a word processor letters lists: a to z, then aa to zz, and so on; null below 1."""
    return F.when(n >= 1, F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int")))


def path_parts(location: Column) -> Column:
    """What a location such as /body/tbl[2]/tr[1]/tc[3]/p[1] says: how many tables deep it is, the paths of its innermost table, row and
    cell (null outside tables), and whether it lies in a text box."""
    inner = lambda tag: F.nullif(F.regexp_extract(location, rf"^(.*/{tag}\[\d+\])", 1), F.lit(""))
    return F.struct(F.regexp_count(location, F.lit(r"/tbl\[")).alias("depth"), inner("tbl").alias("table"), inner("tr").alias("row"), inner("tc").alias("cell"), location.contains("/txbxContent").alias("text_box"))


def repaired(text: Column) -> Column:
    """Text of a printed page for display: single letters that were set apart are joined again, and blanks before punctuation and
    inside brackets go."""
    joined = F.regexp_replace(text, r"(?<=(?:^|\s)\p{L})\s(?=\p{L}(?:\s|$))", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"\s+([.,;:!?)\]])", "$1"), r"([(\[])\s+", "$1"), r"\s+", " "))


def json_field(text: Column, field: str, kind: str) -> Column:
    """A field of a JSON object as (value, state): OK, MISSING, WRONG_KIND (it isn't of ``kind``, one of string, number and boolean), or
    NOT_JSON, so that a caller can refuse it by name and nothing is dropped unsaid."""
    whole, raw = F.try_parse_json(text), f"$.{field}"
    found = F.try_variant_get(whole, raw, "variant")
    shape = F.schema_of_variant(found)
    good = {"string": shape == "STRING", "number": shape.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), "boolean": shape == "BOOLEAN"}[kind]
    state = F.when(whole.isNull(), "NOT_JSON").when(found.isNull(), "MISSING").when(F.coalesce(good, F.lit(False)), "OK").otherwise("WRONG_KIND")
    return F.struct(F.when(state == "OK", F.try_variant_get(whole, raw, "string")).alias("value"), state.alias("state"))


@F.pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """NFC and single white space. Spark has no normal forms, so this goes by Arrow."""
    return texts.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).split()))


@F.pandas_udf(StringType())
def strict_json(texts: pd.Series) -> pd.Series:
    """A JSON text with its keys in order, so that equal values have equal texts; null if it is no JSON or repeats a key in an object,
    which Spark's own parsers pass over."""

    def object_(pairs: list[tuple]) -> dict:
        if len(dict(pairs)) != len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(json.loads(s, object_pairs_hook=object_), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """The search key: no diacritics, no white space, đ as d, lower case. Spark has no normal forms, so this goes by Arrow."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
        return "".join(bare.replace("đ", "d").replace("Đ", "D").lower().split())

    return texts.map(one)


def doubled_share(text: Column) -> Column:
    """The share of neighbouring letters that are equal; null with fewer than 12 letters."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]", "")
    n = F.length(letters)
    return F.when(n >= 12, F.regexp_count(letters, F.lit(r"(.)(?=\1)")) / (n - 1))
