"""Problem 10: the subject areas of each text, by curated weighted terms and a multi-pattern automaton.

One Aho-Corasick automaton holds the weighted vocabulary of all areas in three languages (subject_terms.txt: the everyday
and technical words of each subject, none taken for its place in a corpus). Each text is folded (markup, entities, case,
umlauts, accents, zero-width characters) and read whole, once. Terms are counted by the sentences they occur in. A term
counts by its curated weight and by its rarity among all texts (document frequencies of the whole corpus, aggregated in
Spark). An area's weight is set against that of all subject matter in the text (share) and against the text's length
(density, weight per sentence), and it is assigned above thresholds that ``calibrate`` fits to the hand labels.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

#: Thresholds as fitted by ``calibrate`` to the labels at scale 0.1: an area needs MIN_SENTENCES sentences, MIN_SHARE of the
#: weight of all subject matter and MIN_DENSITY of weight a sentence of the text; or MAIN_SHARE in at least MIN_RATE of all sentences.
MIN_SENTENCES = 2
MIN_SHARE = 0.175
MIN_DENSITY = 1.0
MIN_RATE = 0.25
MAIN_SHARE = 0.5
#: ``calibrate`` reads so many labelled texts at most, chosen by a hash of their ids.
CALIBRATION_TEXTS = 5_000

_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_BOUNDARY = re.compile(r"[.!?;\n](?:(?<=\n)|(?=\s))")
#: Endings that a whole word may take in German, English and French, after folding.
_INFLECTED = re.compile(r"(?:e|en|er|es|em|n|ns|s|se|sen|ses|x)(?![a-z])")
_RUN = re.compile(r"[^\S\n]{2,}|[\t\r\x0b\x0c\x1c-\x1f]")
_CONTROLS = dict.fromkeys([*range(9), *range(14, 28), 127])
# Letters that fold to two; all other marks fall with the decomposition.
_TWO = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("’", "'"), ("‘", "'"), ("\u2028", " "), ("\x85", " ")]


def fold(text: str) -> str:
    """Lower-case ASCII without markup, entities, accents, hidden characters and other scripts; umlauts as two letters.

    Lines stay apart; other white space is single blanks.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).lower()
        for a, b in _TWO:
            text = text.replace(a, b)
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return _RUN.sub(" ", text.lower().translate(_CONTROLS))


def read_terms() -> list[tuple[str, int, str]]:
    """(area, weight, term) of the curated list."""
    rows = []
    for line in files("palimpsest.llm").joinpath("subject_terms.txt").read_text("utf-8").splitlines():
        if line and not line.startswith("#"):
            area, weight, terms = line.split("|")
            rows += [(area, int(weight), t) for t in terms.split(";")]
    return rows


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Folded pattern -> (area, weight, pattern, its forms: (may follow letters, may go on))."""
    found = ahocorasick.Automaton()
    for area, weight, term in read_terms():
        pattern = fold(term.strip("*"))
        # A pattern belongs to the area that lists it first.
        first, heavy, _, forms = found.get(pattern, (area, weight, pattern, ()))
        found.add_word(pattern, (first, heavy, pattern, (*forms, (term[0] == "*", term[-1] == "*"))))
    found.make_automaton()
    return found


def sentence_hits(text: str) -> tuple[list[tuple[int, str, str, int]], int]:
    """((number of the sentence, area, term, weight), each at most once per sentence; how many sentences there are).

    Of the terms that fit at a place the longest counts; a term fits if its word begins and ends as it may.
    """
    folded = fold(text)
    best: dict[int, tuple[int, str, int, str]] = {}
    for end, (area, weight, pattern, forms) in automaton().iter(folded):
        begin = end + 1 - len(pattern)
        starts = not begin or not folded[begin - 1].isalpha()
        closes = not folded[end + 1 : end + 2].isalpha() or _INFLECTED.match(folded, end + 1)
        if not any((starts or inner) and (closes or goes_on) for inner, goes_on in forms):
            continue
        if begin not in best or best[begin][0] < end:
            best[begin] = (end, area, weight, pattern)
    found, reach = [], -1
    for begin in sorted(best):
        end, area, weight, pattern = best[begin]
        if begin > reach:
            reach = end
            if weight:
                found.append((begin, area, pattern, weight))
    ends = [m.start() for m in _BOUNDARY.finditer(folded)]
    sentences = sum(1 for a, z in zip([0, *ends], [*ends, len(folded)]) if z - a > 2)
    return list(dict.fromkeys((bisect.bisect_left(ends, begin), area, term, weight) for begin, area, term, weight in found)), max(sentences, 1)


_HITS = "doc_id bigint, n_sentences int, area string, term string, weight int, sentences array<int>"


def term_hits(documents: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, area, term, weight, sentences): the numbers of the sentences of each text with each term.

    One pass, no shuffle. Null, empty and blank texts and rows without doc_id have none.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                hits, sentences = sentence_hits(text)
                by: dict[tuple[str, str, int], list[int]] = {}
                for number, area, term, weight in hits:
                    by.setdefault((area, term, weight), []).append(number)
                rows += [(doc, sentences, area, term, weight, numbers) for (area, term, weight), numbers in by.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "n_sentences", "area", "term", "weight", "sentences"])

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).mapInPandas(scan, _HITS)


def area_scores(hits: DataFrame, texts: int) -> DataFrame:
    """(doc_id, area, in_sentences, share, density, rate) from the term hits of all texts.

    ``texts``: how many texts there are. The document frequencies have one row per curated term, so they are small
    whatever the corpus; the weight of a sentence for an area is that of its heaviest term.
    """
    frequency = hits.groupBy("area", "term").agg(F.count("*").alias("df"))
    rarity = F.log1p(F.lit(float(max(texts, 1))) / F.col("df"))
    weighted = hits.join(F.broadcast(frequency), ["area", "term"]).select("doc_id", "n_sentences", "area", F.explode("sentences").alias("sentence"), (F.col("weight") * rarity).alias("weight"))
    per_sentence = weighted.groupBy("doc_id", "area", "sentence").agg(F.max("weight").alias("weight"), F.max("n_sentences").alias("n"))
    per_area = per_sentence.groupBy("doc_id", "area").agg(F.count("*").alias("in_sentences"), F.sum("weight").alias("weight"), F.max("n").alias("n"))
    gathered = per_area.groupBy("doc_id").agg(F.collect_list(F.struct("area", "in_sentences", "weight", "n")).alias("areas"), F.sum("weight").alias("total"))
    return gathered.select("doc_id", "total", F.inline("areas")).select(
        "doc_id", "area", "in_sentences", (F.col("weight") / F.col("total")).alias("share"), (F.col("weight") / F.col("n")).alias("density"), (F.col("in_sentences") / F.col("n")).alias("rate")
    )


def assign(scores: DataFrame, min_share: float = MIN_SHARE, min_density: float = MIN_DENSITY, min_rate: float = MIN_RATE) -> DataFrame:
    """(doc_id, area) of the areas above the thresholds."""
    enough = (F.col("in_sentences") >= MIN_SENTENCES) & (F.col("share") >= min_share) & (F.col("density") >= min_density)
    return scores.where(enough | ((F.col("share") >= MAIN_SHARE) & (F.col("rate") >= min_rate))).select("doc_id", "area")


def calibrate(scores: DataFrame, labels: DataFrame, texts: int = CALIBRATION_TEXTS) -> tuple[float, float, float]:
    """(min_share, min_density, min_rate) with the best F1 on at most ``texts`` labelled texts; of equals the strictest.

    ``labels``: doc_id, area; labels in any case, some of them wrong.
    """
    clean = labels.select("doc_id", F.lower(F.trim("area")).alias("area")).dropna().distinct()
    chosen = clean.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    true = clean.join(chosen, "doc_id", "left_semi").withColumn("true", F.lit(True))
    sample = scores.join(chosen, "doc_id", "left_semi").join(true, ["doc_id", "area"], "full_outer").fillna(False, ["true"]).fillna(0).toPandas()
    right, results = sample["true"].to_numpy(), []
    for share in (0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3):
        for density in (0.0, 0.25, 0.5, 0.75, 1.0):
            for rate in (0.1, 0.15, 0.2, 0.25, 0.34, 0.5):
                enough = (sample["in_sentences"] >= MIN_SENTENCES) & (sample["share"] >= share) & (sample["density"] >= density)
                found = (enough | ((sample["share"] >= MAIN_SHARE) & (sample["rate"] >= rate))).to_numpy()
                results.append((2 * (found & right).sum() / max(found.sum() + right.sum(), 1), share, density, rate))
    # Of thresholds that the labels do not tell apart the strictest hold, density first.
    good = [(density, rate, share) for f1, share, density, rate in results if f1 >= max(results)[0]]
    density, rate, share = max(good)
    return share, density, rate


def subject_scores(documents: DataFrame) -> DataFrame:
    """The scores of every area that any text touches.

    The texts are scanned once; their hits, a few short rows per text, are materialised for the corpus statistics.
    """
    hits = cut_lineage(term_hits(documents))
    return area_scores(hits, documents.count())


def subject_areas(documents: DataFrame) -> DataFrame:
    """(doc_id, area): every subject area each text deals with; texts without subject matter have no row."""
    return assign(subject_scores(documents)).distinct()
