"""Language identification by compression with one zstandard dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The bounded training sample: so many documents of each language, so many bytes of letters in a dictionary, so many
#: characters of a document in it, cut into pieces from all over the document in this order.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES, DOCUMENT_CHARACTERS = 200, 64 << 10, 1024
SPREAD = (0, 4, 2, 6, 1, 5, 3, 7)
#: Bytes of a text that are compressed at a time, so that a dictionary counts through all of a long text.
PIECE = 1024
#: Compression level and shortest match: short matches are what tells languages apart.
LEVEL, SHORTEST = 5, 4
#: A prediction is rejected if the second smallest size is larger by a smaller share than this.
MARGIN = 0.02


def letters(text):
    """Lower-cased words of letters, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+", " "))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES, characters: int = DOCUMENT_CHARACTERS) -> dict[str, bytes]:
    """The dictionary of each language of docs: letters of `sample` documents at most, in the order of a hash of their id.

    Each task passes on `sample` ids of a language at most.  Of a text, `characters` at most are looked at, in eight pieces
    from its beginning to its end; a dictionary takes one piece of each document in turn until it is full.  Rows without id
    or language and texts without letters teach nothing and take no place.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.select("id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("id").distinct()
    texts = known.join(F.broadcast(chosen), "id")  # `sample` ids of each language
    whole, piece = F.col("t"), -(-characters // len(SPREAD))
    spare = F.greatest(F.length("t") - piece, F.lit(0))
    start = lambda k: F.floor(spare * k / (len(SPREAD) - 1)).cast("int")
    pieces = [F.when(F.length("t") > characters, whole.substr(start(k) + 1, F.lit(piece))).otherwise(F.substring("t", k * piece + 1, piece)) for k in SPREAD]
    short = texts.select("lang", F.xxhash64("id").alias("h"), "id", letters(F.col("text")).alias("t")).select("lang", "h", "id", F.array(*pieces).alias("pieces"))
    of: dict[str, list[list[str]]] = {}
    for r in short.dropDuplicates(["lang", "id"]).orderBy("lang", "h", "id").collect():
        of.setdefault(r["lang"], []).append(r["pieces"])
    out: dict[str, bytes] = {}
    for lang, found in sorted(of.items()):
        d = bytearray()
        for k in range(len(SPREAD)):
            for own in found:
                if len(d) < size and own[k]:
                    d += own[k].encode()[: size - len(d)] + b" "
        if d:
            out[lang] = bytes(d)
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs; only the text is looked at.

    A text's letters are compressed piece by piece with each language's dictionary as raw content; the smallest total wins,
    of equal ones the first language by name.  score: the share by which the second smallest is larger than the smallest
    (0 to 1; 1 if only one language was learned); rejected: the score is below `margin`.  A null text and a text without
    letters get `und`, score 0, rejected.  Null ids and repeated rows are rows as any other; an empty table gives no rows;
    with no dictionary every text is `und`.
    """
    names = list(dictionaries)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        made = []
        for lang in names:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(dictionaries[lang]), min_match=SHORTEST, write_content_size=0)
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes()
                if not data or not made:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                sizes = np.array([sum(len(press(p)) for p in parts) for press in made])
                best = int(sizes.argmin())
                second = int(np.delete(sizes, best).min(initial=2**62))
                langs.append(names[best])
                scores.append((second - int(sizes[best])) / second)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), letters(F.col(text_col)).alias("t")).mapInArrow(rows, "doc_id long, lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < margin)
