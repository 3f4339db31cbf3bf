"""Text and label functions (F1-F15, F19-F25). Built-in expressions wherever Spark has them; the rest are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, IntegerType


def _each(function):
    """A string UDF that runs once per distinct value of a batch; null stays null."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        codes, values = pd.factorize(text, use_na_sentinel=True)
        done = pd.Series([function(v) for v in values] + [None], dtype=object)
        return pd.Series(done.to_numpy()[codes], index=text.index, dtype=object)

    return run


def fold_for_search(text: str) -> str:
    """Casefold, decompose, drop marks that follow a Latin letter, anything but letters and digits to one blank.

    Marks of other scripts carry meaning and stay.
    """
    kept, latin = [], False
    for c in unicodedata.normalize("NFKD", text.casefold()):
        if unicodedata.combining(c):
            if not latin:
                kept.append(c)
            continue
        latin = c.isalpha() and unicodedata.name(c, "").startswith("LATIN")
        kept.append(c)
    words = "".join(c if c.isalnum() or unicodedata.combining(c) else " " for c in unicodedata.normalize("NFC", "".join(kept)))
    return " ".join(words.split())


_DASHES = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")
_QUOTES = dict.fromkeys(map(ord, "„“”‟«»\"‚‘’"), "'")


def fold_legal_name(text: str) -> str:
    """NFKC, no soft hyphens, one kind of dash and quote, single blanks, casefold."""
    text = unicodedata.normalize("NFKC", text).replace("­", "").translate(_DASHES | _QUOTES)
    return " ".join(text.split()).casefold()


def fold_for_match(text: str) -> str:
    """As :func:`fold_legal_name`, with words that a line break hyphenated joined again."""
    return fold_legal_name(re.sub(r"(?<=\w)[-­]\s*\n\s*(?=[a-zäöüß])", "", text))


search_fold, legal_name, match_text = _each(fold_for_search), _each(fold_legal_name), _each(fold_for_match)


def squeeze(text: Column) -> Column:
    """runs of white space of any kind to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    """lower case, other characters than a-z and 0-9 to single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def ascii_name(text: Column) -> Column:
    """lower case up to the first comma, umlauts as two letters, only ASCII kept."""
    name = F.lower(F.substring_index(text, ",", 1))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.translate(name, "éèêáàâíìîóòôúùûçñ", "eeeaaaiiiooouuucn"), r"[^\x20-\x7e]", ""))


def norm_label(label: Column) -> Column:
    """struct<kind, number> of a section label: kind 'para' (§) or 'art' (Art., Artikel), the number in lower case without blanks.

    Null where the label names no section. ``number`` alone and ``kind:number`` are the other two views of it.
    """
    kind = F.when(label.rlike(r"^\s*§"), "para").when(label.rlike(r"(?i)^\s*art(?:ikel|icle)?\b\.?"), "art")
    number = F.lower(F.regexp_replace(F.regexp_extract(label, r"(\d+\s*[A-Za-z]?)(?![A-Za-z])", 1), r"\s", ""))
    return F.when(number != "", F.struct(kind.alias("kind"), number.alias("number")))


_ROMAN = [(50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def roman(n: int) -> str:
    """Lower-case Roman numeral of 1 to 89."""
    text = ""
    for value, letters in _ROMAN:
        text += letters * (n // value)
        n %= value
    return text


def book_aliases(name: Column, highest: int = 50) -> Column:
    """F8: an abbreviation with its spellings: without a closing edition year, and with one book number, at any place, in Roman letters."""
    whole = F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))
    bare = F.regexp_replace(whole, r"(?<=.) (?:1[89]|2[01])\d{2}$| 2200$", "")
    numerals = F.create_map(*[x for n in range(1, highest + 1) for x in (F.lit(str(n)), F.lit(roman(n)))])

    def variants(text: Column) -> Column:
        words = F.split(text, " ")
        changed = F.transform(words, lambda w, i: F.when(F.element_at(numerals, w).isNotNull(), F.array_join(F.transform(words, lambda x, j: F.when(j == i, F.element_at(numerals, x)).otherwise(x)), " ")))
        return F.array_compact(changed)

    return F.array_distinct(F.concat(F.array(whole, bare), variants(whole), variants(bare)))


def name_forms(name: Column) -> Column:
    """a bounded list of the genitive and weak-adjective forms of a German act's name; nothing is stemmed."""
    genitive = F.when(name.rlike(r"(?:gesetz|recht|buch)$"), F.array(F.concat(name, F.lit("es")), F.concat(name, F.lit("s")))).when(
        name.rlike(r"(?:ordnung|verfassung|verordnung|satzung)$"), F.array(name)
    ).otherwise(F.array(F.concat(name, F.lit("s"))))
    weak = F.when(name.rlike(r"(?i)^\p{Lu}\w+(?:es|er)\s"), F.array(F.regexp_replace(name, r"^(\w+?)(?:es|er)(\s)", "$1en$2")))
    return F.array_distinct(F.concat(F.array(name), genitive, F.coalesce(weak, F.array().cast("array<string>"))))


def eli_key(uri: Column) -> Column:
    """the part of an ELI after 'eli/', lower case, underscores as hyphens."""
    return F.replace(F.lower(F.nullif(F.regexp_extract(uri, r"(?i)eli/([^?#\s]+?)/?$", 1), F.lit(""))), F.lit("_"), F.lit("-"))


def celex(reference: Column) -> Column:
    """CELEX number of an EU reference in the styles '(EU) 2016/679', 'Nr. 1234/2008' and '95/46/EG'; null for others."""
    letter = F.when(F.lower(reference).contains("richtlinie") | F.lower(reference).contains("directive"), "L").otherwise("R")
    new = F.regexp_extract(reference, r"\((?:EU|EG|EC|EURATOM)[^)]*\)\s*(\d{4})/(\d{1,4})", 1), F.regexp_extract(reference, r"\((?:EU|EG|EC|EURATOM)[^)]*\)\s*(\d{4})/(\d{1,4})", 2)
    number = F.regexp_extract(reference, r"(?:Nr\.|No\.?)\s*(\d{1,4})/(\d{4})", 2), F.regexp_extract(reference, r"(?:Nr\.|No\.?)\s*(\d{1,4})/(\d{4})", 1)
    old = F.regexp_extract(reference, r"\b(\d{2})/(\d{1,4})/(?:EG|EWG|EC|EEC)", 1), F.regexp_extract(reference, r"\b(\d{2})/(\d{1,4})/(?:EG|EWG|EC|EEC)", 2)
    code = lambda year, n: F.concat(F.lit("3"), year, letter, F.lpad(n, 4, "0"))
    century = F.when(old[0].try_cast("int") < 50, F.concat(F.lit("20"), old[0])).otherwise(F.concat(F.lit("19"), old[0]))
    return F.when(new[0] != "", code(*new)).when(number[0] != "", code(*number)).when(old[0] != "", code(century, old[1]))


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&sect;", "§"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&amp;", "&")]


def html_text(fragment: Column) -> Column:
    """text of an HTML fragment: line breaks kept, tags dropped, the entities of German statutes resolved."""
    text = F.regexp_replace(F.regexp_replace(fragment, r"(?i)<br\s*/?>|</p>", "\n"), r"<[^<>]*>", "")
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"^\s+|\s+$", "")


# German month names.
GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()


def german_date(day: Column) -> Column:
    """'1. Februar 2024'."""
    names = F.array(*map(F.lit, GERMAN_MONTHS))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.element_at(names, F.month(day)), F.lit(" "), F.year(day).cast("string"))


def snippet(text: Column, terms: list[str], width: int = 260) -> Column:
    """``width`` characters of the squeezed text centred on the earliest term (of terms at one place the longest), with ellipses.

    Without a term the beginning; near the end of the text the window moves back so that it stays full.
    """
    value = squeeze(text)
    low = F.lower(value)
    best = None
    for t in sorted(terms, key=len, reverse=True):
        found = F.struct(F.when(F.instr(low, t) > 0, F.instr(low, t)).otherwise(F.lit(1 << 30)).alias("at"), F.lit(-len(t)).alias("n"))
        best = found if best is None else F.least(best, found)
    centre = best["at"] - 1 + F.floor(-best["n"] / 2)
    end = F.least(F.length(value), F.greatest(centre - width // 2, F.lit(0)) + width)
    start = F.when(best["at"] == 1 << 30, F.lit(0)).otherwise(F.greatest(end - width, F.lit(0)))
    stop = F.least(F.length(value), start + width)
    body = F.trim(F.substring(value, start.cast("int") + 1, F.lit(width)))
    return F.concat(F.when(start > 0, "… ").otherwise(""), body, F.when(stop < F.length(value), " …").otherwise(""))


def excerpt(text: Column, start: Column, end: Column, left: int = 100, right: int = 180, most: int = 360) -> Column:
    """``left`` characters before and ``right`` after the span [start, end) (0-based), at most ``most``, with ellipses."""
    a = F.greatest(F.lit(0), start - left)
    b = F.least(F.length(text), end + right, a + most)
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "…").otherwise(""))


def expand_numbers(text: Column, cap: int = 200) -> Column:
    """the numbers of a list such as '3, 5 bis 8 und 10a', ranges filled in, sorted, at most ``cap`` per range.

    A range above the cap or in falling order gives its two ends only; suffix ranges '78a bis 78d' run over the letters.
    """
    items = F.split(F.regexp_replace(F.lower(text), r"\s*(?:,|;|und|oder|sowie|and|or)\s+", ","), ",")
    pair = lambda x: F.split(F.regexp_replace(x, r"\s*(?:bis|to|–)\s*", "~"), "~")

    def spread(x: Column) -> Column:
        ends = F.transform(pair(x), F.trim)
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        a, b = F.regexp_extract(low, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(high, r"^(\d+)", 1).try_cast("int")
        x1, x2 = F.ascii(F.regexp_extract(low, r"^\d+([a-z])$", 1)), F.ascii(F.regexp_extract(high, r"^\d+([a-z])$", 1))
        plain = high.rlike(r"^\d+$") & low.rlike(r"^\d+$") & (a <= b) & (b - a < cap)
        letters = (a == b) & (x1 > 0) & (x2 >= x1)
        return (
            F.when(plain, F.transform(F.sequence(a, F.when(plain, b).otherwise(a)), lambda n: n.cast("string")))
            .when(letters, F.transform(F.sequence(x1, F.when(letters, x2).otherwise(x1)), lambda n: F.concat(a.cast("string"), F.chr(n))))
            .otherwise(F.filter(ends, lambda e: e.isNotNull() & (e != "")))
        )

    return F.array_distinct(F.flatten(F.transform(items, spread)))


def uri_tail(uris: Column) -> Column:
    """last path segments of an array of URIs, joined by '+'."""
    return F.array_join(F.transform(uris, lambda u: F.element_at(F.split(F.rtrim(u), "/"), -1)), "+")


def as_list(value: Column) -> Column:
    """a scalar as a list of one; null as an empty list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def short_title(title: Column, most: int = 160) -> Column:
    """a title without boilerplate beginnings, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(squeeze(title), r"^(?i:(?:entwurf eines |erstes |zweites |drittes )?gesetz(?:es)? (?:zur|zum|über|für) (?:die |den |das )?)", ""), 1, most)


def safe_filename(name: Column) -> Column:
    """letters, digits, dots, hyphens; never empty."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(clean == "", "document").otherwise(clean)


def quoted(text: Column) -> Column:
    """a JSON (and YAML) string literal."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


_PARAGRAPH = re.compile(r"^\s*\((\d+[a-z]?)\)\s*", re.M)
_SENTENCE_END = re.compile(r"(?<!\bNr)(?<!\bAbs)(?<!\bArt)(?<!\bvgl)(?<!\bRn)(?<!\bDrs)(?<!\d)[.!?](?=\s|$)")


def paragraphs_of(text: str) -> list[dict]:
    """Paragraphs '(1) …' of a section with their place and number of sentences; text without numbers is paragraph ''."""
    marks = list(_PARAGRAPH.finditer(text))
    bounds = [(m.group(1), m.end(), marks[i + 1].start() if i + 1 < len(marks) else len(text)) for i, m in enumerate(marks)]
    if not marks or text[: marks[0].start()].strip():
        bounds.insert(0, ("", 0, marks[0].start() if marks else len(text)))
    return [{"number": n, "start": a, "end": b, "sentences": max(1, len(_SENTENCE_END.findall(text[a:b])))} for n, a, b in bounds]


def paragraphs(text: Column) -> Column:
    """array<struct<number,start,end,sentences>>; null for null, one empty paragraph for an empty text."""
    kind = ArrayType(StructType([StructField("number", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("sentences", IntegerType())]))

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else paragraphs_of(t))

    return run(text)
