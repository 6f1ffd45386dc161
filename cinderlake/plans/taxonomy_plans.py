"""Texts classified by a taxonomy that is read from a table: a class an item of ``benchmark``, its words and word pairs as keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import taxonomy as T
from .registry import query, table

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CLEAN = r"regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s-]', ' ', 'g')"
_WORDS = rf"list_filter(string_split_regex({_CLEAN}, '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


def item_taxonomy(spark, sf_dir):
    """class (group.item), keyword: an item's first ten words, and the first five pairs of neighbouring words as phrases."""
    t = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("group"), F.col("item_id") % 5, F.lit(".item"), F.col("item_id")).alias("class"), T.cleaned(F.col("text")).alias("clean"))
    plain = F.filter(F.split("clean", r"\s+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(0), F.least(F.size("plain"), F.lit(6)) - 2), lambda i: F.concat_ws(" ", F.get("plain", i), F.get("plain", i + 1)))
    t = t.select("class", plain.alias("plain"), F.slice(T.words(F.col("clean")), 1, 10).alias("first"))
    return t.select("class", F.explode(F.concat("first", F.when(F.size("plain") >= 2, pairs).otherwise(F.array().cast("array<string>")))).alias("keyword"))


@query(
    "taxonomy_classify",
    rf"""WITH b AS (SELECT 'group' || item_id % 5 || '.item' || item_id AS class, list_filter(string_split_regex({_CLEAN}, '\s+'), lambda w: w <> '') AS plain, ({_WORDS})[1:10] AS first FROM benchmark),
k AS (SELECT DISTINCT class, keyword FROM (SELECT class, unnest(first) AS keyword FROM b UNION ALL SELECT class, unnest(list_transform(range(1, least(len(plain), 6)), lambda i: plain[i] || ' ' || plain[i + 1])) FROM b)),
d AS (SELECT doc_id, {_CLEAN} AS clean, {_WORDS} AS terms FROM documents),
p AS (SELECT doc_id, phrase FROM d JOIN (SELECT DISTINCT keyword AS phrase FROM k WHERE contains(keyword, ' ')) ON contains(clean, phrase)),
h AS (SELECT doc_id, class, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS keyword FROM d UNION ALL SELECT doc_id, phrase FROM p) JOIN k USING (keyword) GROUP BY ALL),
t AS (SELECT doc_id, len(terms) + (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS t FROM d),
c AS (SELECT doc_id, class, n, least(n / greatest(max(n) OVER (PARTITION BY doc_id), t) + 0.02 * (len(class) - len(replace(class, '.', ''))), 0.99) * CASE WHEN n < t / 2 THEN 0.7 ELSE 1 END AS conf FROM h JOIN t USING (doc_id)),
s AS (SELECT doc_id, class, n, conf / greatest(sum(conf) OVER (PARTITION BY doc_id), 1) AS conf FROM c)
SELECT doc_id, class, CAST(n AS BIGINT) AS matches, round(conf, 6) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(conf, 9) DESC, class) AS rank FROM s) WHERE rank <= 3""",
)
def taxonomy_classify(spark, sf_dir):
    """The three best classes of each document."""
    found = T.classify(table(spark, sf_dir, "documents"), item_taxonomy(spark, sf_dir))
    return found.select("doc_id", "class", "matches", rnd("confidence").alias("confidence"), "rank")
