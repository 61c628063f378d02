"""Counts, trees, taggers and their evaluation."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.catalog.registry import query, stored, table
from weftline.catalog.text import IS_PUNCT, LETTERS_SQL, WORDS_SQL, split_tokens, tokens_sql
from weftline.operators import counts as k
from weftline.operators import tagging as tg
from weftline.operators import tree as tr
from weftline.operators.alignment import Unit, cheapest_chain
from weftline.operators.chunking import Grammar, chunk
from weftline.operators.context import islands, syllable_breaks
from weftline.operators.dealing import spread
from weftline.operators.entities import pause_features
from weftline.plans import stages
from weftline.plans.pipeline import Pipeline

#: CTE bg: doc_id, label, feats of labelled documents.
BAGS_SQL = r"""
    bg AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, list_sort(list_filter(['lang:' || lang, 'source:' || source, CASE WHEN length(text) < 300 THEN 'short' WHEN length(text) < 3000 THEN 'mid' ELSE 'long' END,
      CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(text, '[%$#*&]{3}') THEN 'junk' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'link' END,
      CASE WHEN regexp_matches(text, '@') THEN 'at' END, CASE WHEN regexp_matches(text, '[|]') THEN 'bar' END, CASE WHEN regexp_matches(text, '[(]c[)]|License|Copyright') THEN 'license' END], lambda x: x IS NOT NULL)) AS feats
      FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""


def grown_sql(bags: str, asked: str, keys: str, depth: int, cut_off: int) -> str:
    """CTEs that grow a tree on `bags` (label, feats, n) level by level and send `asked` (keys, feats) down it; the last, pr, has keys and predicted."""
    parts = [f"b0 AS (SELECT label, feats, n, 1 AS node FROM {bags})", f"p0 AS (SELECT {keys}, feats, 1 AS node FROM {asked})"]
    for d in range(depth):
        parts.append(f"""
    t{d} AS (SELECT node, label, CAST(sum(n) AS DOUBLE) AS al FROM b{d} GROUP BY node, label), w{d} AS (SELECT node FROM t{d} GROUP BY node HAVING count(*) > 1 AND sum(al) >= {cut_off}),
    y{d} AS (SELECT node, feature, label, CAST(sum(n) AS DOUBLE) AS ye FROM (SELECT node, label, n, unnest(list_distinct(feats)) AS feature FROM b{d} WHERE node IN (SELECT node FROM w{d})) GROUP BY ALL),
    z{d} AS (SELECT f.node, f.feature, al, coalesce(ye, 0) AS ye FROM (SELECT DISTINCT node, feature FROM y{d}) f JOIN t{d} USING (node) LEFT JOIN y{d} ON y{d}.node = f.node AND y{d}.feature = f.feature AND y{d}.label = t{d}.label),
    s{d} AS (SELECT node, feature, sum(al) AS tn, sum(ye) AS yn, sum(al - ye) AS nn, sum(al * log2(al)) AS ta, sum(CASE WHEN ye > 0 THEN ye * log2(ye) ELSE 0 END) AS ya, sum(CASE WHEN al > ye THEN (al - ye) * log2(al - ye) ELSE 0 END) AS na FROM z{d} GROUP BY node, feature),
    g{d} AS (SELECT node, feature, round((tn * log2(tn) - ta - (yn * log2(yn) - ya) - (nn * log2(nn) - na)) / tn, 9) AS gain FROM s{d} WHERE yn >= 1 AND nn >= 1),
    c{d} AS (SELECT node, feature FROM g{d} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature) = 1),
    b{d + 1} AS (SELECT label, feats, n, CASE WHEN feature IS NULL THEN b{d}.node WHEN list_contains(feats, feature) THEN 2 * b{d}.node ELSE 2 * b{d}.node + 1 END AS node FROM b{d} LEFT JOIN c{d} ON c{d}.node = b{d}.node),
    p{d + 1} AS (SELECT {keys}, feats, CASE WHEN feature IS NULL THEN p{d}.node WHEN list_contains(feats, feature) THEN 2 * p{d}.node ELSE 2 * p{d}.node + 1 END AS node FROM p{d} LEFT JOIN c{d} ON c{d}.node = p{d}.node)""")
    parts.append(f"lf AS (SELECT node, label AS predicted FROM (SELECT node, label, sum(n) AS n FROM b{depth} GROUP BY node, label) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)")
    parts.append(f"pr AS (SELECT {keys}, predicted FROM p{depth} JOIN lf USING (node))")
    return ", ".join(parts)


#: CTEs: the bags of all documents and the labelled ones' counts.
TREE_SQL = f"{BAGS_SQL}, {BAGS_SQL.replace('bg AS', 'ab AS').replace('CAST(quality AS VARCHAR) AS label, ', '').replace('JOIN labels USING (doc_id) WHERE quality IS NOT NULL', '')}, lb AS (SELECT label, feats, count(*) AS n FROM bg GROUP BY ALL)"
#: crc32 of a doc_id's digits.
CRC_SQL = """tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
    cr AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM documents, tb)"""


def features(text: Column) -> Column:
    """A document's bag of features, sorted."""
    flag = lambda pattern, name: F.when(text.rlike(pattern), name)
    n = F.char_length(text)
    found = F.array(
        F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.when(n < 300, "short").when(n < 3000, "mid").otherwise("long"), flag("[0-9]", "digit"), flag("[%$#*&]{3}", "junk"),
        flag("https?://", "link"), flag("@", "at"), flag("[|]", "bar"), flag("[(]c[)]|License|Copyright", "license"),
    )
    return F.array_sort(F.array_compact(found))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, label, feats: labelled documents; the bags are made before the join, so no text is shuffled."""
    bags = table(spark, sf, "documents").select("doc_id", features(F.col("text")).alias("feats"))
    return bags.join(table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")


def counted_bags(spark: SparkSession, sf: str) -> DataFrame:
    return k.bag_counts(labelled(spark, sf), "label", "feats")


@query(rf"""
    WITH {WORDS_SQL}, c AS (SELECT word, CAST(quality AS VARCHAR) AS label, count(*) AS n FROM wd JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL)
    SELECT word, label, n, round(n / sum(n) OVER (PARTITION BY word), 6) AS p FROM c
""")
def word_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    quality = table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("string").alias("label"))
    per_doc = split_tokens(spark, sf).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("m")).join(quality, "doc_id")
    counts = per_doc.groupBy("word", "label").agg(F.sum("m").alias("n"))
    return k.conditional(counts, ["word"]).withColumn("p", F.round("p", 6))


@query(f"WITH {BAGS_SQL} SELECT label, list_aggregate(feats, 'string_agg', ' ') AS feats, count(*) AS n FROM bg GROUP BY ALL")
def feature_bag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counted_bags(spark, sf).withColumn("feats", F.array_join("feats", " "))


@query(f"""
    WITH {BAGS_SQL}, c AS (SELECT d.lang, label, count(*) AS n FROM bg JOIN documents d USING (doc_id) GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang)
    SELECT lang, CAST(total AS BIGINT) AS total, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (lang) GROUP BY lang, total
""")
def label_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of quality within each language."""
    langs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    return k.entropy(langs.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n")), ["lang"]).withColumn("entropy", F.round("entropy", 6))


@query(f"""
    WITH {BAGS_SQL}, a AS (SELECT label, CAST(count(*) AS DOUBLE) AS al FROM bg GROUP BY label), fx AS (SELECT label, unnest(list_distinct(feats)) AS feature FROM bg),
    y AS (SELECT feature, a.label, al, CAST((SELECT count(*) FROM fx WHERE fx.feature = f.feature AND fx.label = a.label) AS DOUBLE) AS ye FROM (SELECT DISTINCT feature FROM fx) f, a),
    s AS (SELECT feature, sum(al) AS tn, sum(ye) AS yn, sum(al - ye) AS nn, list(al) AS als, list(ye) AS yes, list(al - ye) AS nos FROM y GROUP BY feature),
    h AS (SELECT feature, tn, yn, nn, -list_sum(list_transform(als, lambda x: x / tn * log2(x / tn))) AS h0, -list_sum(list_transform(list_filter(yes, lambda x: x > 0), lambda x: x / yn * log2(x / yn))) AS h1,
      -list_sum(list_transform(list_filter(nos, lambda x: x > 0), lambda x: x / nn * log2(x / nn))) AS h2 FROM s WHERE nn > 0)
    SELECT feature, yn AS yes, nn AS no, round(h0 - yn / tn * h1 - nn / tn * h2, 6) + 0.0 AS gain FROM h
""")
def information_gains(spark: SparkSession, sf: str) -> DataFrame:
    """What each feature gains about quality."""
    return k.information_gain(counted_bags(spark, sf)).withColumn("gain", F.round("gain", 6) + F.lit(0.0))


@query("""
    WITH c AS (SELECT d.source, l.quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
    r AS (SELECT source, quality, n, n / sum(n) OVER (PARTITION BY source) AS p, row_number() OVER (PARTITION BY source ORDER BY n DESC, quality) - 1 AS rank FROM c)
    SELECT source, rank, CAST(quality AS VARCHAR) AS label, round(p, 6) AS p FROM r
""")
def leaf_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """Qualities of each source with their shares, the most frequent first."""
    counts = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    return k.leaf_distribution(counts, ["source"], "label").select("source", F.posexplode("dist").alias("rank", "d")).select("source", F.col("rank").cast("long").alias("rank"), F.col("d.label").alias("label"), F.round("d.p", 6).alias("p"))


@query(f"WITH {TREE_SQL}, {grown_sql('lb', 'ab', 'doc_id', 6, 8)} SELECT doc_id, predicted FROM pr")
def tree_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document by a tree grown on the labelled ones."""
    model = tr.grow(counted_bags(spark, sf), cut_off=8, max_depth=6)
    return tr.classify(table(spark, sf, "documents").select("doc_id", features(F.col("text")).alias("feats")), model, "feats").select("doc_id", "predicted")


@query(f"""
    WITH {TREE_SQL}, {CRC_SQL}, tr AS (SELECT label, feats, count(*) AS n FROM bg JOIN cr USING (doc_id) WHERE crc % 5 <> 0 GROUP BY ALL), te AS (SELECT doc_id, label, feats, feats[list_position(list_transform(feats, lambda f: starts_with(f, 'source:')), true)] AS source FROM bg JOIN cr USING (doc_id) WHERE crc % 5 = 0),
    {grown_sql('tr', 'te', 'doc_id, label, source', 5, 8)}
    SELECT 'document' AS unit, avg(CAST(predicted = label AS DOUBLE)) AS accuracy FROM pr UNION ALL SELECT 'source', avg(ok) FROM (SELECT CAST(min(CAST(predicted = label AS INT)) AS DOUBLE) AS ok FROM pr GROUP BY source)
""")
def tree_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by document and by source of a tree grown on documents that are not every fifth."""
    rows = labelled(spark, sf).withColumn("source", F.element_at(F.filter("feats", lambda f: f.startswith("source:")), 1))
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = tr.grow(k.bag_counts(rows.filter(~fifth), "label", "feats"), cut_off=8, max_depth=5)
    tested = tr.classify(rows.filter(fifth), model, "feats")
    item = k.item_accuracy(tested, F.col("predicted"), F.col("label")).select(F.lit("document").alias("unit"), "accuracy")
    return item.union(k.group_accuracy(tested, ["source"], F.col("predicted"), F.col("label")).select(F.lit("source"), "accuracy"))


@query(r"""
    WITH r AS (SELECT d.lang, quality = 1 AS gold, NOT regexp_matches(text, '[%$#*&]{3}') AS predicted FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    c AS (SELECT lang, sum(CAST(gold AND predicted AS INT)) AS tp, sum(CAST(predicted AS INT)) AS pp, sum(CAST(gold AS INT)) AS gp FROM r GROUP BY lang)
    SELECT lang, round(coalesce(tp / nullif(pp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(gp, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + gp, 0), 0), 6) AS f1 FROM c
""")
def rule_f_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How well the absence of junk marks finds good documents, by language."""
    rule = table(spark, sf, "documents").select("doc_id", "lang", (~F.col("text").rlike("[%$#*&]{3}")).alias("predicted"))
    rows = rule.join(table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id")
    return k.f_score(rows, "predicted", "gold", ["lang"]).select("lang", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(rf"""
    WITH {WORDS_SQL}, f AS (SELECT word, min(doc_id * 1000000 + pos) AS first FROM wd GROUP BY word)
    SELECT word, row_number() OVER (ORDER BY first) AS id FROM f WHERE word <> '#' UNION ALL SELECT '#', 0
""")
def vocabulary_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of tokens in the order of their first appearance; 0 is kept."""
    bounds = table(spark, sf, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    return k.vocabulary(split_tokens(spark, sf), "word", ["doc_id", "pos"], bounds=tuple(bounds))


@query(f"""
    WITH {LETTERS_SQL}, c AS (SELECT word, ix, substr(word, ix + 1, 1) IN ('a', 'e', 'i', 'o', 'u', 'y') AS vowel FROM ch),
    v AS (SELECT word, ix, CASE WHEN vowel THEN 'N' WHEN coalesce(lead(vowel) OVER w, false) THEN 'O' ELSE 'C' END AS label FROM c WINDOW w AS (PARTITION BY word ORDER BY ix)),
    b AS (SELECT word, ix, label, CAST(coalesce(label = lag(label) OVER w OR (label = 'O' AND lag(label) OVER w IN ('N', 'C')), false) AS INT) AS brk FROM v WINDOW w AS (PARTITION BY word ORDER BY ix)),
    i AS (SELECT word, ix, label, sum(brk) OVER (PARTITION BY word ORDER BY ix ROWS UNBOUNDED PRECEDING) AS island FROM b)
    SELECT word, CAST(island AS BIGINT) AS island, string_agg(label, '' ORDER BY ix) AS labels FROM i GROUP BY word, island
""")
def syllable_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Letters of each distinct word grouped to syllables by labels from a vowel rule."""
    w = Window.partitionBy("word").orderBy("char_pos")
    letters = lexicon_letters(split_tokens(spark, sf))
    broken = islands(letters, syllable_breaks("label", w), ["word"], "char_pos")
    grouped = broken.groupBy("word", F.col("island").cast("long").alias("island")).agg(F.array_sort(F.collect_list(F.struct("char_pos", "label"))).alias("l"))
    return grouped.select("word", "island", F.array_join(F.transform("l", lambda x: x["label"]), "").alias("labels"))


def lexicon_letters(tokens: DataFrame, least: int = 1) -> DataFrame:
    """word, char_pos, char, label: letters of words that occur at least so often, labelled N, O or C by a vowel rule."""
    words = tokens.filter(F.col("word").rlike(r"\p{L}")).select(F.lower("word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    chars = words.withColumn("chars", F.filter(F.split("word", ""), lambda c: c != ""))
    vowel = lambda c: c.isin("a", "e", "i", "o", "u", "y")
    label = lambda c, i: F.when(vowel(c), "N").when(F.coalesce(vowel(F.get("chars", i + 1)), F.lit(False)), "O").otherwise("C")
    rows = F.transform("chars", lambda c, i: F.struct(i.alias("char_pos"), c.alias("char"), label(c, i).alias("label")))
    return chars.select("word", F.inline(rows))


def sound_tree() -> tr.Node:
    """A tree over letters and the label before: ch is one sound, other c's are k, vowels V, other letters C."""
    leaf = lambda label: tr.Node(1, 0, dist=[(label, 1.0)])
    node = lambda feature, yes, no: tr.Node(1, 0, feature, yes, no)
    rest = node("c0:h", node("plab:X", leaf("-"), leaf("C")), leaf("C"))
    for vowel in "aeiou":
        rest = node(f"c0:{vowel}", leaf("V"), rest)
    return node("c0:c", node("c1:h", leaf("X"), leaf("k")), rest)


@query()
def annotated_words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words with syllables and stresses from trees trained on the frequent ones; every word is annotated once."""
    tokens = split_tokens(spark, sf)
    letters = lexicon_letters(tokens, least=30)
    w = Window.partitionBy("word").orderBy("char_pos")
    context = [F.concat(F.lit(f"c{d}:"), (F.lag("char", -d, "_") if d < 0 else F.lead("char", d, "_")).over(w) if d else F.col("char")) for d in range(-3, 4)]
    bags = letters.select("label", F.array(*context, F.concat(F.lit("plab:"), F.lag("label", 1, "_").over(w))).alias("feats"))
    model = tr.grow(k.bag_counts(bags, "label", "feats"), cut_off=10, max_depth=8)
    first = tr.Node(1, 0, dist=[("-", 1.0)])
    stressed = tr.Node(1, 0, "plab:_", tr.Node(1, 0, dist=[("PS", 1.0)]), first)
    held = spark.sparkContext.broadcast((model, stressed))

    @F.pandas_udf("struct<syllables:array<string>,stress:array<int>>")
    def annotate(words: pd.Series) -> pd.DataFrame:
        syllabifier, stresser = held.value
        found = [tg.syllabify(x, syllabifier) for x in words]
        return pd.DataFrame({"syllables": found, "stress": [tg.stress(x, "N", s, stresser) for x, s in zip(words, found, strict=True)]})

    distinct = tokens.filter(F.col("word").rlike(r"\p{L}")).select(F.lower("word").alias("word"))
    return tg.distinct_then_join(distinct.groupBy("word").agg(F.count(F.lit(1)).alias("n")), ["word"], lambda d: d.withColumn("a", annotate("word"))).select("word", "n", "a.syllables", "a.stress")


@query(rf"""
    WITH RECURSIVE {WORDS_SQL}, lw AS (SELECT lower(word) AS word, count(*) AS n FROM wd WHERE regexp_matches(word, '\p{{L}}') GROUP BY 1), lt AS (SELECT word, unnest(range(length(word))) AS ix FROM lw WHERE n >= 30),
    lv AS (SELECT word, ix, CASE WHEN substr(word, ix + 1, 1) IN ('a', 'e', 'i', 'o', 'u', 'y') THEN 'N' WHEN substr(word, ix + 2, 1) IN ('a', 'e', 'i', 'o', 'u', 'y') THEN 'O' ELSE 'C' END AS label FROM lt),
    lf0 AS (SELECT label, list_append(list_transform(range(-3, 4), lambda d: 'c' || d || ':' || CASE WHEN ix + d BETWEEN 0 AND length(word) - 1 THEN substr(word, ix + d + 1, 1) ELSE '_' END), 'plab:' || lag(label, 1, '_') OVER (PARTITION BY word ORDER BY ix)) AS feats FROM lv),
    lc AS (SELECT label, feats, count(*) AS n FROM lf0 GROUP BY ALL), {grown_sql("lc", "lc", "label", 8, 10)},
    sp AS (SELECT node, feature, starts_with(feature, 'plab:') AS by_label, try_cast(regexp_extract(feature, '^c(-?[0-9]):', 1) AS INT) AS d, regexp_extract(feature, '^[^:]*:(.*)$', 1) AS ch FROM ({" UNION ALL ".join(f"SELECT * FROM c{d}" for d in range(8))})),
    rc AS (SELECT word, CAST(0 AS BIGINT) AS ix, CAST(1 AS BIGINT) AS node, '_' AS prev, CAST(NULL AS VARCHAR) AS label FROM lw UNION ALL
      SELECT word, CASE WHEN feature IS NULL THEN ix + 1 ELSE ix END, CASE WHEN feature IS NULL THEN 1 WHEN CASE WHEN by_label THEN ch = prev ELSE ch = CASE WHEN ix + d BETWEEN 0 AND length(word) - 1 THEN substr(word, CAST(ix + d + 1 AS INT), 1) ELSE '_' END END THEN 2 * rc.node ELSE 2 * rc.node + 1 END,
        CASE WHEN feature IS NULL THEN predicted ELSE prev END, CASE WHEN feature IS NULL THEN predicted END FROM rc LEFT JOIN sp ON sp.node = rc.node LEFT JOIN lf ON lf.node = rc.node WHERE ix < length(word)),
    ll AS (SELECT word, ix, label, lag(label) OVER (PARTITION BY word ORDER BY ix) AS before FROM rc WHERE label IS NOT NULL),
    lb AS (SELECT word, ix, before IS NOT NULL AND (label = before OR starts_with(label, 'O') AND before[1] IN ('N', 'C')) AS brk FROM ll),
    sy AS (SELECT word, string_agg(CASE WHEN brk THEN '-' ELSE '' END || substr(word, CAST(ix AS INT), 1), '' ORDER BY ix) AS syllables, sum(CAST(brk AS INT)) AS breaks FROM lb GROUP BY word)
    SELECT word, n, syllables, CASE WHEN breaks = 0 THEN '0' ELSE '1' || repeat('-0', CAST(breaks AS INT)) END AS stress FROM sy JOIN lw USING (word)
""")
def annotated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same with syllables and stresses joined by hyphens."""
    return annotated_words(spark, sf).select("word", "n", F.array_join("syllables", "-").alias("syllables"), F.array_join(F.col("stress").cast("array<string>"), "-").alias("stress"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    plan = Pipeline({"doc_id", "text"}, [stages.sentences, stages.tokenize, stages.normalise, stages.parse, stages.short_pauses, stages.coarse_tags])
    return plan(table(spark, sf, "documents").select("doc_id", "text"))


#: Words that occur so often have a lexicon entry; the others have the candidates of their suffixes.
KNOWN = 2


def context_tags(tags: str) -> Column:
    """Coarse tags, those of words with where they stand: e before a mark or the end, b after a short word, c elsewhere."""
    place = lambda i: F.when(F.coalesce(F.get(tags, i + 1), F.lit("P")) == "P", "e").when((i > 0) & (F.get(tags, i - 1) == "S"), "b").otherwise("c")
    return F.transform(tags, lambda t, i: F.when(t.isin("P", "N"), t).otherwise(F.concat(t, place(i))))


def tag_model(held: DataFrame) -> tuple[tg.TagModel, DataFrame]:
    """From sentences (words, tags): tags' counts and transitions with a suffix tree over the lexicon, and the lexicon: word, n, known (counts of its tags).

    Words, tags and next tags are counted in one pass. A model has a row for each pair of tags; the lexicon grows with the
    vocabulary, so it stays a table.
    """
    following = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("tags", i).alias("tag"), F.coalesce(F.get("tags", i + 1), F.lit(k.EDGE)).alias("next")))
    counted = stored(held.select(F.inline(following)).groupBy("word", "tag", "next").agg(F.count(F.lit(1)).alias("n")), "word-tags")
    moves = [(r["tag"], r["next"], r["n"]) for r in counted.groupBy("tag", "next").agg(F.sum("n").alias("n")).collect()]
    tags = Counter()
    for tag, _, n in moves:
        tags[tag] += n
    by_word = counted.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    entries = by_word.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("tag", "n")).alias("known"))
    lexicon = stored(entries.filter(F.col("n") >= KNOWN), "lexicon")
    bags = lexicon.select("word", F.inline("known")).select(F.col("tag").alias("label"), tg.suffix_features(F.col("word"), 3).alias("feats"), "n")
    suffixes = tr.grow(bags.groupBy("label", "feats").agg(F.sum("n").alias("n")), cut_off=200, max_depth=3)
    return tg.TagModel(dict(tags), {}, {(tag, after): n / tags[tag] for tag, after, n in moves}, suffixes, tg.grand_total(tags, lexicon)), lexicon


#: CTEs: tokens, sl (sentences) and tt (tags of tokens by form).
TAGS_SQL = rf"""{tokens_sql("documents", "doc_id")}, sl AS (SELECT doc_id, CAST(sent_id AS INT) AS sent_id FROM tk_l WHERE trim(line) <> ''),
    tt AS (SELECT doc_id, CAST(sent_id AS INT) AS sent_id, pos, word, CASE WHEN {IS_PUNCT} THEN 'P' WHEN regexp_matches(word, '^\p{{Nd}}') THEN 'N' WHEN regexp_matches(word, '^\p{{Lu}}') THEN 'U' WHEN length(word) <= 3 THEN 'S' ELSE 'W' END AS tag FROM tk)"""


#: CTEs: tokens with tags by context, the model's tables and its candidates (ca: doc_id, sent_id, pos, word, no, e: a tag's number and its log emission in millionths), and em: the number of tags and a row of all log transitions.
VITERBI_SQL = f"""{TAGS_SQL},
    tn AS (SELECT doc_id, sent_id, pos, word, tag AS base, coalesce(lag(tag) OVER w, 'P') AS before, coalesce(lead(tag) OVER w, 'P') AS after FROM tt WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
    tf AS (SELECT doc_id, sent_id, pos, word, CASE WHEN base IN ('P', 'N') THEN base WHEN after = 'P' THEN base || 'e' WHEN before = 'S' THEN base || 'b' ELSE base || 'c' END AS tag FROM tn),
    wt AS (SELECT word, tag, count(*) AS n FROM tf GROUP BY ALL), lx AS (SELECT word, tag, n FROM wt WHERE word IN (SELECT word FROM wt GROUP BY word HAVING sum(n) >= {KNOWN})),
    tc AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY tag) AS no FROM tf GROUP BY tag), al AS (SELECT (SELECT sum(n) FROM tc) + (SELECT coalesce(sum(n), 0) FROM lx) AS total),
    mv AS (SELECT tag AS prev, coalesce(lead(tag) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), '') AS next FROM tf), mc AS (SELECT prev, next, count(*) AS n FROM mv GROUP BY ALL), mp AS (SELECT prev, next, n / sum(n) OVER (PARTITION BY prev) AS p FROM mc),
    em AS (SELECT (SELECT count(*) FROM tc) AS k, list(CAST(round(ln(coalesce(p, 1 / (total + 1))) * 1e6) AS BIGINT) ORDER BY a.no, b.no) AS t FROM tc a CROSS JOIN tc b CROSS JOIN al LEFT JOIN mp ON mp.prev = a.tag AND mp.next = b.tag),
    su AS (SELECT tag AS label, list_transform(range(3), lambda i: 'e' || i || ':' || CASE WHEN length(word) > i THEN substr(word, length(word) - i, 1) ELSE '_' END) AS feats, sum(n) AS n FROM lx GROUP BY ALL),
    un AS (SELECT word, list_transform(range(3), lambda i: 'e' || i || ':' || CASE WHEN length(word) > i THEN substr(word, length(word) - i, 1) ELSE '_' END) AS feats FROM (SELECT DISTINCT word FROM tf WHERE word NOT IN (SELECT word FROM lx))),
    {grown_sql("su", "un", "word", 3, 200)},
    cd AS (SELECT word, no, CAST(round(ln(lx.n / (tc.n + 1)) * 1e6) AS BIGINT) AS e FROM lx JOIN tc USING (tag) UNION ALL
      SELECT p3.word, no, CAST(round(ln(1 / (tc.n + 1)) * 1e6) AS BIGINT) FROM p3 JOIN (SELECT DISTINCT node, label FROM b3) q ON q.node = p3.node JOIN tc ON tc.tag = q.label),
    ca AS (SELECT doc_id, sent_id, pos, word, no, e FROM tf JOIN cd USING (word))"""


@query(f"""
    WITH {VITERBI_SQL},
    po AS (SELECT doc_id, sent_id, pos, list({{'s': e, 'neg': CAST(0 AS BIGINT), 'path': chr(CAST(96 + no AS INT)), 'no': no}} ORDER BY no) AS c FROM ca GROUP BY ALL), se AS (SELECT doc_id, sent_id, list(c ORDER BY pos) AS cs FROM po GROUP BY ALL),
    dp AS (SELECT doc_id, sent_id, list_reduce(cs, lambda acc, x: list_transform(x, lambda c: list_sort(list_transform(acc, lambda p: {{'s': p.s + t[(p.no - 1) * k + c.no] + c.s, 'neg': -p.no, 'path': p.path || c.path, 'no': c.no}}), 'DESC')[1])) AS last FROM se, em),
    pa AS (SELECT doc_id, sent_id, list_sort(list_transform(last, lambda p: {{'s': p.s, 'neg': -p.no, 'path': p.path}}), 'DESC')[1].path AS path FROM dp)
    SELECT sl.doc_id, sl.sent_id, coalesce(array_to_string(list_transform(string_split(path, ''), lambda x: names[ascii(x) - 96]), ' '), '') AS tags FROM sl LEFT JOIN pa USING (doc_id, sent_id), (SELECT list(tag ORDER BY no) AS names FROM tc)
""")
def viterbi_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest tags of every sentence, where tags depend on what stands beside a word; words seen once are known by their suffixes."""
    coarse = sentences(spark, sf).select("doc_id", "sent_id", "words", "tags").withColumnRenamed("tags", "coarse")
    held = stored(coarse.select("doc_id", "sent_id", "words", context_tags("coarse").alias("tags"), F.monotonically_increasing_id().alias("row")), "sentences")
    model, lexicon = tag_model(held)
    found = tg.label_by_lexicon(held.select("row", "doc_id", "sent_id", "words"), "row", "words", lexicon, model, "found")
    return found.select("doc_id", "sent_id", F.array_join("found", " ").alias("tags"))


#: Rules over coarse tags.
RULES = """
Np -> ('<U>' | '<W>') '<W>'+ Tail?
Tail -> '<P>' '<W>'
Pp -> '<S>' ('<W>' | '<U>')
Ap -> '<N>' '<W>'?
Vp -> '<W>' '<S>' '<S>'*
"""


#: CTEs: tags and tc (doc_id, sent_id, pos, c: the chunks that a token is in).
CHUNKS_SQL = f"""{TAGS_SQL}, ts AS (SELECT doc_id, sent_id, string_agg(tag, '' ORDER BY pos) AS t FROM tt GROUP BY ALL),
    ru AS (SELECT doc_id, sent_id, 'Np' AS kind, 1 AS no, regexp_extract_all(t, '(?:[UW]W(?:PW)?).?|.') AS ps FROM ts UNION ALL SELECT doc_id, sent_id, 'Pp', 2, regexp_extract_all(t, '(?:S[WU]).?|.') FROM ts
      UNION ALL SELECT doc_id, sent_id, 'Ap', 3, regexp_extract_all(t, '(?:NW?).?|.') FROM ts UNION ALL SELECT doc_id, sent_id, 'Vp', 4, regexp_extract_all(t, '(?:WSS?).?|.') FROM ts),
    pt AS (SELECT doc_id, sent_id, kind, no, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM ru),
    ac AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id, sent_id, no ORDER BY i) - length(p) AS start, CASE no WHEN 1 THEN length(regexp_extract(p, '^([UW]W(?:PW)?)', 1)) WHEN 2 THEN length(regexp_extract(p, '^(S[WU])', 1)) WHEN 3 THEN length(regexp_extract(p, '^(NW?)', 1)) ELSE length(regexp_extract(p, '^(WSS?)', 1)) END AS n FROM pt),
    nm AS (SELECT doc_id, sent_id, no, start, n, kind || row_number() OVER (PARTITION BY doc_id, sent_id, no ORDER BY i) AS name FROM ac WHERE n > 1),
    ox AS (SELECT doc_id, sent_id, start + unnest(range(n)) AS pos, no, name FROM nm), tc AS (SELECT doc_id, sent_id, pos, string_agg(name, ',' ORDER BY no) AS c FROM ox GROUP BY ALL)"""


@query(f"""
    WITH {CHUNKS_SQL}
    SELECT sl.doc_id, sl.sent_id, coalesce(string_agg(coalesce(c, ''), ' ' ORDER BY tt.pos) FILTER (tt.pos IS NOT NULL), '') AS chunks FROM sl LEFT JOIN tt USING (doc_id, sent_id) LEFT JOIN tc ON tc.doc_id = tt.doc_id AND tc.sent_id = tt.sent_id AND tc.pos = tt.pos GROUP BY ALL
""")
def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every sentence by a small grammar over its tags."""
    spans = tg.label_arrays(sentences(spark, sf), "tags", chunk, Grammar(RULES), "chunks")
    return spans.select("doc_id", "sent_id", F.array_join("chunks", " ").alias("chunks"))


@query(rf"""
    WITH {TAGS_SQL}, wf AS (SELECT word, tag AS label, n AS m, list_sort(list_distinct(list_prepend('case:' || CASE WHEN upper(word) = word AND lower(word) <> word THEN 'upper' WHEN regexp_matches(word, '^\p{{Lu}}') THEN 'first' ELSE 'lower' END,
      list_transform(range(5), lambda i: 'w' || i || ':' || CASE WHEN length(word) > i THEN substr(word, length(word) - i, 1) ELSE '_' END)))) AS feats FROM (SELECT word, tag, count(*) AS n FROM tt GROUP BY ALL)),
    lc AS (SELECT label, feats, sum(m) AS n FROM wf GROUP BY label, feats), {grown_sql("lc", "wf", "word", 6, 200)}
    SELECT sl.doc_id, sl.sent_id, coalesce(string_agg(predicted, ' ' ORDER BY pos), '') AS tags FROM sl LEFT JOIN tt USING (doc_id, sent_id) LEFT JOIN pr ON pr.word = tt.word GROUP BY ALL
""")
def greedy_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags left to right by a tree over forms, trained on sentences' coarse tags. Words are counted before their forms are made."""
    rows = sentences(spark, sf).select(F.inline(F.arrays_zip("words", "tags"))).toDF("word", "tag").groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    case = F.when((F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word")), "case:upper").when(F.col("word").rlike(r"^\p{Lu}"), "case:first").otherwise("case:lower")
    bags = rows.select(F.col("tag").alias("label"), F.array_sort(F.array_distinct(F.concat(F.array(case), tg.suffix_features(F.col("word"), 5, "w")))).alias("feats"), "n")
    model = tr.grow(bags.groupBy("label", "feats").agg(F.sum("n").alias("n")), cut_off=200, max_depth=6)
    return tg.label_arrays(sentences(spark, sf), "words", tg.greedy_tags, model, "found").select("doc_id", "sent_id", F.array_join("found", " ").alias("tags"))


@query()
def unit_chains(spark: SparkSession, sf: str) -> DataFrame:
    """For each user's values the cheapest chain of stored values of the same kind, by distance and jump between units; null where a value to be met is null.

    Tasks get kinds as numbers and values as flat arrays, and hold objects for one user's chain at a time.
    """
    kinds = ("click", "view", "purchase", "signup", "logout")
    units = [Unit(kind, "f", at, at + 1) for kind in kinds for at in range(0, 100, 5)]
    # By kind's number; 0 is for all others, which have one unit of no cost.
    starts = [np.zeros(1), *(np.array([u.start for u in units if u.phone == kind], float) for kind in kinds)]
    joints = [[np.abs(a[:, None] - b) * 0.5 for b in starts] for a in starts]

    def chain_of(codes: np.ndarray, values: np.ndarray) -> tuple[float | None, str | None]:
        if np.isnan(values[codes > 0]).any():
            return None, None
        cost, chain = cheapest_chain([np.abs(starts[k] - v) if k else np.zeros(1) for k, v in zip(codes, values, strict=True)], lambda k: joints[codes[k]][codes[k + 1]])
        return round(cost, 6), " ".join(str(int(starts[k][at])) for k, at in zip(codes, chain, strict=True))

    def run(batches):
        for batch in batches:
            codes, values = batch.column("codes"), batch.column("values")
            at, code, value = codes.offsets.to_numpy(), codes.values.to_numpy(), values.values.to_numpy(zero_copy_only=False)
            shift = values.offsets.to_numpy() - at
            found = [chain_of(code[a:b], value[a + d : b + d]) for a, b, d in zip(at[:-1], at[1:], shift[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), pa.array([c for c, _ in found], pa.float64()), pa.array([x for _, x in found], pa.string())], ["user_id", "cost", "starts"])

    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value")))
    dealt = spread(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id").groupBy("user_id").agg(ordered.alias("seq"))
    number = lambda e: F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), e["event_type"]), F.lit(0)).cast("tinyint")
    flat = dealt.select("user_id", F.transform("seq", number).alias("codes"), F.transform("seq", lambda e: e["value"]).alias("values"))
    return flat.mapInArrow(run, "user_id long, cost double, starts string")


@query("""
    WITH ev AS (SELECT user_id, list([value, CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup', 'logout') THEN 0.0 ELSE 1.0 END] ORDER BY event_id) AS e FROM events GROUP BY user_id),
    st AS (SELECT user_id, e, list_transform(range(20), lambda j: CASE WHEN e[1][2] = 0 THEN abs(5 * j - e[1][1]) WHEN j = 0 THEN 0.0 ELSE 1e18 END) AS first FROM ev),
    dp AS (SELECT user_id, list_reduce(list_prepend(first, e[2:]), lambda acc, x: list_transform(range(20), lambda j: list_min(list_transform(range(20), lambda i: acc[i + 1] + abs(5 * i - 5 * j) * 0.5)) + CASE WHEN x[2] = 0 THEN abs(5 * j - x[1]) WHEN j = 0 THEN 0.0 ELSE 1e18 END)) AS last FROM st)
    SELECT user_id, round(list_min(last), 6) AS cost FROM dp
""")
def unit_chain_costs(spark: SparkSession, sf: str) -> DataFrame:
    """The costs of those chains."""
    return unit_chains(spark, sf).select("user_id", "cost")


def _grown_on_tokens(spark: SparkSession, sf: str, label: Column, depth: int) -> DataFrame:
    """Tokens with the token after them in the document, labelled, and the label that a tree over their edges gives; counted."""
    from weftline.catalog.text import doc_tokens
    from weftline.operators.entities import boundary_features

    w = Window.partitionBy("doc_id").orderBy("sent_id", "pos")
    rows = doc_tokens(spark, sf).withColumns({"next_word": F.lead("word").over(w), "next_sent": F.lead("sent_id").over(w)})
    bags = rows.select(label.alias("label"), boundary_features(rows).alias("feats")).groupBy("label", "feats").agg(F.count(F.lit(1)).alias("n"))
    model = tr.grow(bags, cut_off=50, max_depth=depth)
    return tr.classify(bags, model, "feats").groupBy("label", "predicted").agg(F.sum("n").alias("n"))


def _edges_sql(label: str, depth: int) -> str:
    """Tokens' bags of edges with a label, counted; and the tree over them."""
    return f"""
    WITH {tokens_sql("documents", "doc_id")}, nx AS (SELECT word, sent_id, lead(word) OVER w AS next_word, lead(sent_id) OVER w AS next_sent FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id, pos)),
    eb AS (SELECT {label} AS label, ['last:' || substr(word, -1, 1), 'next:' || substr(coalesce(next_word, '_'), 1, 1), 'upper:' || CASE WHEN upper(substr(coalesce(next_word, '_'), 1, 1)) = substr(coalesce(next_word, '_'), 1, 1) THEN 'true' ELSE 'false' END] AS feats, count(*) AS n FROM nx GROUP BY ALL),
    {grown_sql('eb', 'eb', 'label, n', depth, 50)} SELECT label, predicted, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY ALL"""


@query(_edges_sql("CASE WHEN next_sent IS NULL OR next_sent > sent_id THEN 'yes' ELSE 'no' END", 5))
def sentence_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a token ends its line, by a tree over its last character and the next token's first, against what is so."""
    return _grown_on_tokens(spark, sf, F.when(F.col("next_sent").isNull() | (F.col("next_sent") > F.col("sent_id")), "yes").otherwise("no"), 5)


@query(_edges_sql("CASE WHEN next_word IN (',', ';', ':') THEN '1' ELSE '0' END", 5))
def short_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a pause mark follows a token, by a tree over the edges around it."""
    return _grown_on_tokens(spark, sf, F.when(F.col("next_word").isin(",", ";", ":"), "1").otherwise("0"), 5)


#: The last and the first phone of a token by sound_tree.
LAST_SQL = r"CASE WHEN length(word) = 1 AND NOT regexp_matches(word, '[\p{L}\p{N}]') THEN CASE WHEN word = ',' THEN 'sp' ELSE 'pau' END WHEN regexp_matches(lower(word), '[aeiou]$') THEN 'V' WHEN regexp_matches(lower(word), 'c$') THEN 'k' WHEN regexp_matches(lower(word), 'ch$') THEN '-' ELSE 'C' END"
FIRST_SQL = r"CASE WHEN length(word) = 1 AND NOT regexp_matches(word, '[\p{L}\p{N}]') THEN CASE WHEN word = ',' THEN 'sp' ELSE 'pau' END WHEN regexp_matches(lower(word), '^[aeiou]') THEN 'V' WHEN regexp_matches(lower(word), '^c-*h') THEN 'X' WHEN regexp_matches(lower(word), '^c') THEN 'k' ELSE 'C' END"


@query(rf"""
    WITH {CHUNKS_SQL}, fs AS (SELECT tt.doc_id, tt.sent_id, tt.pos, word, tag, regexp_replace(split_part(coalesce(c, 'null'), ',', 1), '[0-9]+$', '') AS chunk, {LAST_SQL} AS last, {FIRST_SQL} AS first, lead(word) OVER (PARTITION BY tt.doc_id, tt.sent_id ORDER BY tt.pos) AS after
      FROM tt LEFT JOIN tc ON tc.doc_id = tt.doc_id AND tc.sent_id = tt.sent_id AND tc.pos = tt.pos),
    fe AS (SELECT CASE WHEN after IN (',', ';', ':') THEN '1' ELSE '0' END AS label, ['tag:' || tag, 'chunk:' || chunk, 'last:' || last, 'next:' || coalesce(lead(first) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), '.')] AS feats FROM fs WHERE word NOT IN (',', ';', ':')),
    eb AS (SELECT label, feats, feats AS bag, count(*) AS n FROM fe GROUP BY ALL), {grown_sql('eb', 'eb', 'label, bag, n', 6, 20)}
    SELECT list_aggregate(bag, 'string_agg', ' ') AS feats, label, predicted, CAST(n AS BIGINT) AS n FROM pr
""")
def phrase_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a pause follows a token, by a tree over its tag, chunk and last phone and the next token's first phone: counts by bag.

    Tagger, chunker and letter-to-sound rules see each sentence once, and their outputs stay beside its words; nothing is
    shuffled before the counts of bags, whose number is bounded by tags, kinds of chunks and phones.
    """
    chunked = tg.label_arrays(sentences(spark, sf).select("words", "tags"), "tags", chunk, Grammar(RULES), "chunks")
    voiced = tg.label_words(chunked, "words", lambda w, tree: " ".join(tg.letter_to_sound(w, tree)), sound_tree(), "phones")
    bags = voiced.select(F.inline(pause_features("words", "tags", "chunks", "phones"))).groupBy("label", "feats").agg(F.count(F.lit(1)).alias("n"))
    bags = stored(bags, "pause-bags")
    found = tr.classify(bags, tr.grow(bags, cut_off=20, max_depth=6), "feats")
    return found.select(F.array_join("feats", " ").alias("feats"), "label", "predicted", "n")


@query("SELECT count(DISTINCT lang) AS lang_size, count(DISTINCT source) AS source_size, CAST(sum(n_chars) AS BIGINT) AS states FROM documents")
def corpus_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    return k.corpus_sizes(table(spark, sf, "documents"), ["lang", "source"], F.col("n_chars"))


@query(r"SELECT suffix, count(*) AS n FROM (SELECT length(word) - length(rtrim(word, 'sehidngt')) AS suffix FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents)) GROUP BY suffix")
def suffix_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of the lengths of words' endings in s e h i d n g t."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return k.suffix_histogram(words.select((F.char_length("word") - F.char_length(F.rtrim("word", F.lit("sehidngt")))).cast("long").alias("suffix")), "suffix")
