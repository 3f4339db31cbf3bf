"""Problem 8: encoding a whole corpus with a public tokenizer through a distinct-word table.

Texts are split into the tokenizer's words by its own pattern in the JVM, each distinct word is encoded once, and the ids are
joined back by position. The most frequent words, a bounded table, are looked up in Arrow batches where the texts lie: runs
of such words leave as one part with their ids, so neither the bulk of the words nor a word with a large share of
all rows is ever shuffled. Every other word is a part of its own and is joined by a shuffle of these words alone.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from palimpsest.session import cut_lineage

#: Where the public tokenizers' files lie; pass another folder where it differs.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the word pattern of byte_bpe_50k; (?U) gives \s its Unicode meaning in Java.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the broadcast table: (least characters, most characters, words), about 2 MB of common words and at most 4 MB of long ones.
FREQUENT = [(1, 64, 20_000), (65, 1024, 1_000)]


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def ids_of(word: Column, path: str) -> Column:
    """The ids of a word (one piece of the tokenizer's own split)."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        core = _encoding(path)._core_bpe
        return words.map(lambda w: core.encode_single_piece(w.encode("utf-8")))

    return encode(word)


def split_words(documents: DataFrame) -> DataFrame:
    """(doc_id, words) of all texts, in order; null for a null text."""
    return documents.select("doc_id", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("words"))


def word_table(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(word, n, ids): each distinct word of the corpus, counted map-side first and encoded once."""
    counted = split_words(documents).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", "n", ids_of(F.col("word"), os.path.join(folder, f"{name}.tiktoken")).alias("ids"))


def frequent_words(table: DataFrame) -> pa.Table:
    """(word, ids) of the most frequent words, on the driver; bounded by FREQUENT."""
    tiers = [table.where(F.length("word").between(low, high)).orderBy(F.desc("n"), "word").limit(n) for low, high, n in FREQUENT]
    return pa.concat_tables([t.select("word", "ids").toArrow() for t in tiers]).combine_chunks()


def _parts(words: pa.ListArray, known: pa.StringArray, ids: pa.ListArray, runs: bool) -> tuple[np.ndarray, pa.StructArray, np.ndarray]:
    """The parts of a batch of texts: (parts before each text, the parts, ids of known words in each text).

    A part is a run of known words with their ids, if ``runs`` asks for them, or one other word.
    """
    flat = words.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])
    at = pc.index_in(flat, known)
    rare = at.is_null().to_numpy(zero_copy_only=False)
    begins = rare.copy()
    if runs:
        begins[1:] |= rare[:-1]
        begins[offsets[:-1][offsets[:-1] < len(flat)]] = True
    first = np.flatnonzero(begins)
    lengths = np.diff(ids.offsets.to_numpy())
    size = np.where(rare, 0, lengths[pc.fill_null(at, 0).to_numpy(zero_copy_only=False)]) if len(known) else np.zeros(len(flat), np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    if runs:
        part_ids = pa.ListArray.from_arrays(pa.array(np.concatenate([ends[first], ends[-1:]]), pa.int32()), ids.take(at).flatten())
    else:
        part_ids = pa.ListArray.from_arrays(pa.array(np.zeros(len(first) + 1), pa.int32()), pa.array([], pa.int32()))
    part_words = pc.if_else(pa.array(rare[first]), flat.take(pa.array(first)), pa.scalar(None, flat.type))
    text = np.searchsorted(offsets, first, "right") - 1
    structs = pa.StructArray.from_arrays([pa.array((first - offsets[text]).astype(np.int32)), part_ids, part_words], fields=list(_PART))
    return np.searchsorted(first, offsets), structs, np.diff(ends[offsets])


_PART = pa.struct([("pos", pa.int32()), ("ids", pa.list_(pa.int32())), ("word", pa.string())])


def text_parts(documents: DataFrame, table: DataFrame, runs: bool = True) -> DataFrame:
    """(doc_id, known, parts array<struct<pos,ids,word>>): runs of frequent words with their ids, other words with no ids yet.

    In order of ``pos``, the place of a part's first word; null for a null text. ``known`` counts the ids of the frequent words,
    which without ``runs`` have no parts. The result lies by doc_id; rows without one have none.
    """
    frequent = frequent_words(table)
    known, ids = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in frequent.columns)
    known, ids = known.cast(pa.string()), ids.cast(pa.list_(pa.int32()))
    shared = documents.sparkSession.sparkContext.broadcast((known, ids))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        for batch in batches:
            words = batch.column("words").cast(pa.list_(pa.string()))
            before, structs, count = _parts(words, known, ids, runs)
            parts = pa.ListArray.from_arrays(pa.array(before, pa.int32()), structs, mask=words.is_null())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), parts], names=["doc_id", "known", "parts"])

    doc = documents.schema["doc_id"].dataType.simpleString()
    looked_up = split_words(documents).mapInArrow(look_up, f"doc_id {doc}, known bigint, parts array<struct<pos:int,ids:array<int>,word:string>>")
    # The filter that joins infer stands here for every reader, so that their plans of the exchange are the same.
    return looked_up.repartition("doc_id").where(F.col("doc_id").isNotNull())


def rare_parts(parts: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, known, pos, ids) of the words that are not among the frequent ones."""
    # An outer inline infers no filter; both readers of ``parts`` take all its columns. So they share one exchange.
    rare = parts.select("doc_id", "known", F.inline_outer("parts")).where(F.col("word").isNotNull()).select("doc_id", "known", "pos", "word")
    return rare.join(table.select("word", "ids"), "word").select("doc_id", "known", "pos", "ids")


def encode(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids array<int>) of every text, without special tokens; [] for an empty text, null for a null text.

    doc_id names one text; a row delivered twice comes out twice.
    """
    table = cut_lineage(word_table(documents, folder, name))
    parts = text_parts(documents, table)
    rare = rare_parts(parts, table).groupBy("doc_id").agg(F.collect_set(F.struct("pos", "ids")).alias("rare"), F.max("known").alias("seen"))
    known = F.transform("parts", lambda x: F.struct(x["pos"].alias("pos"), x["ids"].alias("ids")))
    # A rare word's own part has no ids; its joined part has the same place.
    placed = F.when(F.col("seen").isNull() & (F.col("known") >= 0), known).otherwise(F.sort_array(F.concat(known, F.col("rare"))))
    return parts.join(rare, "doc_id", "left").select("doc_id", F.flatten(F.transform(placed, lambda x: x["ids"])).alias("ids"))


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, size bigint): the number of ids of every text; 0 for empty and null texts. doc_id names one text."""
    table = cut_lineage(word_table(documents, folder, name))
    parts = text_parts(documents, table, runs=False)
    rare = rare_parts(parts, table).distinct().groupBy("doc_id").agg((F.max("known") + F.sum(F.size("ids"))).alias("all"))
    size = F.when(F.col("parts").isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce("all", "known"))
    return parts.join(rare, "doc_id", "left").select("doc_id", size.alias("size"))


def pieces(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece binary): the tokenizer's vocabulary, a fixed table."""
    lines = spark.read.text(os.path.join("file://" + folder, f"{name}.tiktoken"))
    part = F.split("value", " ")
    return lines.where(F.length("value") > 0).select(F.get(part, F.lit(1)).cast("int").alias("id"), F.unbase64(F.get(part, F.lit(0))).alias("piece"))


def decode(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by joining each id's piece; '' for no ids, null for null ids."""
    placed = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    # The vocabulary has a fixed size of about 50,000 short pieces.
    joined = placed.join(F.broadcast(vocabulary), "id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8")
    bare = encoded.where(F.col("ids").isNull() | (F.size("ids") == 0)).select("doc_id", F.when(F.col("ids").isNotNull(), F.lit("")).alias("text"))
    return joined.select("doc_id", text.alias("text")).unionByName(bare)
