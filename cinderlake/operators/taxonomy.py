"""Classifying texts by a taxonomy table of any size: keywords by join, phrases of several words by multi-pattern search.

A taxonomy is a table (class, keyword); a class is a dotted path, a keyword with a space is a phrase.  A text's terms are its cleaned words (repeats stay) and each phrase
that its cleaned text contains, once.  Words meet keywords in an equi-join, whose side Spark sends by broadcast only while it is small.  Phrases are found in one pass
over the texts for each ``SHARD`` phrases with an automaton that tasks build from that many, so neither the driver nor a task holds more of the taxonomy than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that are no terms.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "after", "during", "before", "near")
#: Fixed values of the confidence: gain a level of the path, limit, factor for matches under half of the terms.
DEPTH_GAIN, LIMIT, FEW = 0.02, 0.99, 0.7
SHARD = 200_000


def cleaned(text: Column) -> Column:
    """Lower case; what is no a-z, 0-9, white space or hyphen is a blank.  A null text is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " ")


def words(clean: Column) -> Column:
    """Words of over 2 characters that are no stopwords, in order; repeats stay."""
    return F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def with_phrases(texts: DataFrame, phrases: DataFrame, shard: int = SHARD) -> DataFrame:
    """``texts`` (with a column clean) with ``found``: the distinct ``phrases`` (phrase) that the text contains."""
    listed = phrases.filter("phrase IS NOT NULL AND phrase <> ''").distinct()
    parts = -(-listed.count() // shard)
    out = texts.withColumn("found", F.array().cast("array<string>"))
    for k in range(parts):
        mine = [r[0] for r in listed.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k).collect()]

        def run(batches: Iterator[pa.RecordBatch], mine: list[str] = mine) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            search = ahocorasick.Automaton()
            for i, p in enumerate(mine):
                search.add_word(p, i)
            search.make_automaton()
            for batch in batches:
                at = batch.schema.get_field_index("found")
                found = [[*had, *(mine[j] for j in {j for _, j in search.iter(text)})] for text, had in zip(batch.column("clean").to_pylist(), batch.column(at).to_pylist(), strict=True)]
                yield batch.set_column(at, "found", pa.array(found, pa.list_(pa.string())))

        out = out.mapInArrow(run, out.schema) if mine else out
    return out


def classify(docs: DataFrame, taxonomy: DataFrame, doc: str = "doc_id", text: str = "text", top: int = 3, shard: int = SHARD) -> DataFrame:
    """doc, class, matches, confidence, rank: the ``top`` classes of each text that has a match.

    With m matches of a class (a keyword listed twice for a class is one; classes may share keywords), t terms of the text and M the text's most matches of a class, the
    confidence is m / max(M, t) + 0.02 a level of the path, 0.99 at most, times 0.7 where m < t / 2; a text's confidences over all classes are divided by their sum where that is over 1.
    Equal confidences rank by class.  Rows that repeat an id are texts of their own.  Texts without terms or matches, null classes and null keywords give no rows.
    """
    known = taxonomy.filter("class IS NOT NULL AND keyword IS NOT NULL").select("class", F.lower("keyword").alias("keyword")).distinct()
    texts = with_phrases(docs.select(F.col(doc).alias("doc"), cleaned(F.col(text)).alias("clean")), known.filter("contains(keyword, ' ')").select(F.col("keyword").alias("phrase")), shard)
    terms = texts.select(F.monotonically_increasing_id().alias("id"), "doc", F.concat(words(F.col("clean")), "found").alias("terms"))
    asked = terms.select("id", "doc", F.size("terms").alias("t"), F.explode("terms").alias("keyword"))
    matches = asked.join(known, "keyword").groupBy("id", "class").agg(F.count("*").alias("matches"), F.first("doc").alias("doc"), F.first("t").alias("t"))
    own = W.partitionBy("id")
    scored = matches.withColumn("most", F.max("matches").over(own))
    depth = F.length("class") - F.length(F.replace("class", F.lit("."), F.lit("")))
    confidence = F.least(F.col("matches") / F.greatest("most", "t") + DEPTH_GAIN * depth, F.lit(LIMIT)) * F.when(F.col("matches") < F.col("t") / 2, FEW).otherwise(1.0)
    scored = scored.withColumn("confidence", confidence).withColumn("all", F.sum("confidence").over(own))
    scored = scored.withColumn("confidence", F.when(F.col("all") > 1, F.col("confidence") / F.col("all")).otherwise(F.col("confidence")))
    ranked = scored.withColumn("rank", F.row_number().over(own.orderBy(F.round("confidence", 9).desc(), "class"))).filter(F.col("rank") <= top)
    return ranked.select(F.col("doc").alias(doc), "class", "matches", "confidence", "rank")
