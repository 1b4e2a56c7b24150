"""Source divergence audit: how far the vocabulary of each source of a language lies from the other sources and from the language.

Relational throughout. Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at least
``min_documents`` of its rows hold. Counts of (language, source, term) are made dense over the kept terms, smoothed to whole billionths, and every pair
of sources of a language is compared term by term. All arithmetic is in whole numbers (decimals where products may pass 64 bits).

Null text, language and source count as ''. Rows are counted as documents whatever their ids, so repeated rows count each time. Sources without a term take
part with zero counts; a language without a kept term has value 0 for every pair. Ties go to the smaller item in UTF-8 order. Other columns are ignored; an empty
table gives an empty result. A hot language, source or term is summed before it is shuffled, and kept terms meet the groups of their language in ``SALTS`` bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise

MIN_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
SALTS = 64
# Fixed value: what a term is.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 kept)), exactly."""
    return (F.call_function("div", F.lit(UNIT).cast("decimal(12,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)")) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^31, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents): occurrences of a term in a group and rows that hold it. One scan; counts are added up before the shuffle."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_extract_all(text, F.lit(TERM), 0).alias("terms"))
    both = rows.select("lang", "source", F.explode(F.array(F.struct(F.lit(0).alias("once"), F.col("terms")), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))).alias("s"))
    return both.select("lang", "source", "s.once", F.explode("s.terms").alias("term")).groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("count"), F.sum("once").cast("long").alias("documents"))


def dense_shares(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, shares): every (lang, source) with its totals; (lang, source, term, count, p, q) for each kept term of the group's language."""
    spread = Window.partitionBy("lang", "term")
    kept = materialise(term_counts(documents).withColumn("held", F.sum("documents").over(spread)).filter(F.col("held") >= min_documents).select("lang", "source", "term", "count"), "kept-terms")
    vocabulary = kept.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    found = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = materialise(found.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"]), "groups")
    bins = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = vocabulary.withColumn("bin", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(bins, ["lang", "bin"])
    filled = cells.join(kept, ["lang", "source", "term"], "left").na.fill(0, ["count"])
    shares = filled.select("lang", "source", "term", "count", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"))
    return groups, materialise(shares, "shares")


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the distance to each other source of the language; part ``term``: what the source says most in excess."""
    groups, shares = dense_shares(documents, min_documents)
    a, b = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"))
    once = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("other"))  # the measure is symmetric
    sums = once.groupBy("lang", "source", "other").agg(F.sum(gap(F.col("p"), F.col("r"))).alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "other"), "lang").filter(F.col("source") != F.col("other")).join(sums, ["lang", "source", "other"], "left")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = shares.filter("count > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    term = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    return pair.unionByName(term)


# The same in DuckDB's SQL.
AUDIT_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS total FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + ({UNIT}::HUGEINT * (w.in_lang + 2)) // (l.total + 2 * l.v) AS q
    FROM groups g JOIN vocabulary w USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
