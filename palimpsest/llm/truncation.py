"""Problem 4: text values that lost their end, by a structural completeness check.

Each value is read once by a stack automaton over its structural characters (quotes, brackets, markup, entities). What is
left open at the end, a broken multibyte sequence, escape or entity, a mark of omission or a hyphen at the end prove a cut.
A value that merely lacks a sentence's terminator is judged against its source: whether the source's whole values end
with terminators, and whether the value lies at the length where the source's values pile up (its field limit).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

#: What the automaton says of a value: complete, provably cut, a sentence without terminator, a closed fragment without one.
COMPLETE, CUT, OPEN_SENTENCE, FRAGMENT = 0, 1, 2, 3

#: A source limits its field if this share of its values lies within the last tenth below the length of 99 % of them.
PILE_SHARE = 0.05
#: ... but not nearly all of them, which are then simply of one length.
WHOLE_SHARE = 0.9
PILE_BAND = 0.9
#: A source that ends fewer of its short values with terminators than this does not write sentences.
TERMINATED_SHARE = 0.5
#: So many values tell how a source writes; with fewer it is taken to write sentences.
TELLING_VALUES = 20

_STRUCTURE = re.compile(r"[„“”‚«»\"()\[\]{}<]")
_TAG = re.compile(r"<(/?)([A-Za-z]\w*)?[^<>]*(/?)(>?)")
_TAG_REST = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'<>]*))?)*\s*/?""")
_CLOSING_TAGS = re.compile(r"(?:\s*</\w+\s*>)+$")
_VOID = {"br", "hr", "img", "p", "li", "td", "tr", "th", "input", "meta", "col"}
#: The longest ending that the patterns below look at.
_ENDING = 120
_PAIRS = {"“": "„", "”": "„“", "»": "«", ")": "(", "]": "[", "}": "{"}
_OPENERS = set("„‚«([{")
_BROKEN_END = re.compile(r"""�$|&(?:[A-Za-z]{1,8}|#\d{0,6}|#x[0-9A-Fa-f]{0,6})?$|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?$|<[/!]?(?:[A-Za-z][\w:-]{0,30}(?:\s+[\w:-]+(?:=(?:"[^"<>]{0,80}"?|[\w-]*))?){0,4}\s*)?$|<[A-Za-z][^<>/]*>$|(?<=\w)[-‐­]$""")
_OMISSION_END = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\))$")
_TERMINATOR = re.compile(r"[.!?:。][\"“”»’')\]]*$")
# Abbreviations and ordinals whose full stop ends no sentence. The citation forms of statutes.
_NO_STOP = re.compile(
    r"(?:\b(?:Abs|Nr|Nrn|vgl|Vgl|Rn|Rdnr|Drs|Art|Artt|Buchst|Halbs|Hs|Ziff|Anl|Kap|Anm|Fn|bzw|ggf|gem|i\. ?V\. ?m|z\. ?B|d\. ?h|u\. ?a|No|para|paras|art|cf|e\. ?g|i\. ?e)"
    r"|\b(?:am|dem|vom|zum|des) (?:[12]?\d|3[01])|\b\d{1,2}\.\d{1,2})\.$"
)
# Closed fragments that whole values consist of: headings, list items, notes in brackets, ranges, dashes, commands.
_FRAGMENT = re.compile(
    r"(?:[-–—]|\([^()]{1,40}\)|(?:\(\d+\w?\)|§ ?\d+\w?|\d+\.?)(?: bis | und |, | to | and |–|-)(?:\(\d+\w?\)|§ ?\d+\w?|\d+\.?) ?(?:…|\.\.\.)"
    r"|(?:Abschnitt|Unterabschnitt|Kapitel|Teil|Titel|Buch|Anlage|Anhang|Section|Chapter|Part|Annex|Titre|Chapitre|Annexe) ?\d+\w?(?:[ :.–-][^.!?]{0,120})?"
    r"|(?:Artikel|Art\.|§§?|Article) ?\d+\w?(?:[ :.–-]+[A-ZÄÖÜÉ„(][^.!?]{0,120}|[.:])?"
    r"|(?:\d{1,3}\w?[.)]|\(?[a-z]{1,2}\)) [^.!?]{1,120}(?:[,;]|[,;]? (?:und|oder|and|or|et|ou))"
    r"|(?:Das|Die) (?:Wort|Wörter|Angabe|Angaben|Zahl) „[^“]*“ (?:wird|werden) [^.!?]{0,200}(?:ersetzt|gestrichen|eingefügt|angefügt|aufgehoben))$"
)
# A sentence with an editorial omission that closes with its reference.
_QUOTED_RULE = re.compile(r"\[(?:…|\.\.\.)\][^.!?]*\([^()]{0,40}\)$")


def left_open(text: str) -> bool:
    """Whether quotes, brackets or markup stay open at the end (stack automaton over the structural characters)."""
    stack: list[str] = []
    for found in _STRUCTURE.finditer(text):
        mark = found.group()
        if mark in _OPENERS:
            stack.append(mark)
        elif mark == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            elif not text[max(found.start() - 1, 0) : found.start()].isdigit():
                # A mark right after a number that closes nothing stands for inches or seconds.
                stack.append(mark)
        elif mark == "<":
            tag = _TAG.match(text, found.start())
            closing, name, empty, complete = tag.groups()
            if not name:
                continue
            if not complete:
                # Cut within a tag only if all that follows could stand in one; else it is the sign for less.
                if _TAG_REST.fullmatch(text, found.start()):
                    return True
                continue
            name = "<" + name.lower()
            if closing and name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not closing and not empty and name[1:] not in _VOID:
                stack.append(name)
        elif mark in _PAIRS:
            # A closer takes the innermost mark it can close; one without an opener, as in "a)", closes nothing.
            for at in range(len(stack) - 1, -1, -1):
                if stack[at] in _PAIRS[mark]:
                    del stack[at:]
                    break
            else:
                if mark == "“":
                    stack.append(mark)
    return bool(stack)


def judge(text: str) -> int:
    """COMPLETE, CUT, OPEN_SENTENCE or FRAGMENT of one value that is neither null nor blank."""
    whole = text.rstrip()
    # Closing tags at the end are part of a complete document; the text before them is judged.
    said = _CLOSING_TAGS.sub("", whole) if whole[-1] == ">" else whole
    end = said[-_ENDING:]
    stop = end[-1:] == "." and end[-2:] != ".."
    if not stop:
        if _BROKEN_END.search(end):
            return CUT
        if _FRAGMENT.fullmatch(said):
            return FRAGMENT
        if _OMISSION_END.search(end):
            return CUT
    if left_open(whole):
        return CUT
    if stop or _TERMINATOR.search(end):
        return CUT if _NO_STOP.search(end) else COMPLETE
    return FRAGMENT if _QUOTED_RULE.search(said) else OPEN_SENTENCE


_JUDGED = "id bigint, source string, field string, verdict int, chars int, bytes int"


def judged(table: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(id, source, field, verdict, chars, bytes) of each value; null, empty and blank values have no row. No shuffle."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for field in fields:
                some = batch[batch[field].notna()]
                some = some[some[field].str.strip() != ""]
                texts = some[field]
                yield pd.DataFrame(
                    {
                        "id": some["id"],
                        "source": some["source"],
                        "field": field,
                        "verdict": [judge(t) for t in texts],
                        "chars": texts.str.len(),
                        "bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                    }
                )

    return table.select(F.col(key).alias("id"), F.coalesce(source, F.lit("")).alias("source"), *fields).mapInPandas(scan, _JUDGED)


def baselines(values: DataFrame) -> DataFrame:
    """(source, char_limit, byte_limit, writes_sentences): one row per source; a limit is null where lengths do not pile up.

    Built from length histograms per source, so a source with a third of all values is aggregated before it is shuffled.
    """

    def limit(unit: str) -> DataFrame:
        counts = values.groupBy("source", unit).agg(F.count("*").alias("n"))
        upward = Window.partitionBy("source").orderBy(unit)
        whole = Window.partitionBy("source")
        below = F.sum("n").over(upward) / F.sum("n").over(whole)
        top = F.min(F.when(F.col("below") >= 0.99, F.col(unit))).over(whole)
        return (
            counts.withColumn("below", below)
            .withColumn("top", top)
            .groupBy("source")
            .agg(F.first("top").alias("top"), (F.sum(F.when(F.col(unit) >= F.col("top") * PILE_BAND, F.col("n")).otherwise(0)) / F.sum("n")).alias("pile"))
            .select("source", F.when(F.col("pile").between(PILE_SHARE, WHOLE_SHARE), F.col("top")).alias(f"{unit}_limit"))
        )

    # Rows a source, of sources with the same values in both units; joined before they meet any value.
    limits = cut_lineage(limit("chars").join(limit("bytes"), "source"))
    short = with_source(values, limits).where(~_at_limit())
    ends = short.groupBy("source").agg(F.avg((F.col("verdict") == COMPLETE).cast("double")).alias("terminated"), F.count("*").alias("n"))
    return limits.join(ends, "source", "left").select(
        "source", "chars_limit", "bytes_limit", F.coalesce((F.col("terminated") >= TERMINATED_SHARE) | (F.col("n") < TELLING_VALUES), F.lit(True)).alias("writes_sentences")
    )


#: So many sources at most go to every executor; the values of more are spread over SPLITS parts of each source.
BROADCAST_SOURCES, SPLITS = 100_000, 64


def with_source(values: DataFrame, sources: DataFrame) -> DataFrame:
    """``values`` joined with one row per source, by broadcast where their counted number allows it, else salted: no source's values meet in one task."""
    if sources.count() <= BROADCAST_SOURCES:
        return values.join(F.broadcast(sources), "source")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    return values.withColumn("salt", F.pmod(F.xxhash64("id", "field"), F.lit(SPLITS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")


def _at_limit():
    reached = lambda unit: F.coalesce(F.col(unit) >= F.col(f"{unit}_limit") * PILE_BAND, F.lit(False))
    return reached("chars") | reached("bytes")


def with_verdicts(table: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(id, source, field, is_cut) of every value that is not blank, one row per delivery."""
    # Short rows without the texts; read several times for the baselines.
    values = cut_lineage(judged(table, key, source, fields))
    verdict = F.col("verdict")
    cut = (verdict == CUT) | ((verdict == OPEN_SENTENCE) & (F.col("writes_sentences") | _at_limit())) | ((verdict == FRAGMENT) & _at_limit())
    return with_source(values, cut_lineage(baselines(values))).select("id", "source", "field", cut.alias("is_cut"))


def cut_values(table: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(id, field) of the values that lost their end; null, empty and blank values are no case."""
    return with_verdicts(table, key, source, fields).where("is_cut").select("id", "field").distinct()


def cut_rates(table: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(source, values, cut, rate): how often each source delivers cut values; repeated deliveries count once."""
    once = with_verdicts(table, key, source, fields).distinct()
    return once.groupBy("source").agg(
        F.count("*").alias("n_values"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 4).alias("rate")
    )
