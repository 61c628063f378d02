"""Lines, items, tokens, characters, predicates, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog.registry import query, table
from weftline.functions import predicates as p
from weftline.functions.text import ascii_only, underscored
from weftline.operators import entities as e
from weftline.operators import tokenize as t
from weftline.operators.context import letter_context, neighbours_in, quinphones, quote_state
from weftline.operators.counts import bigrams_in, conditional, dense_order
from weftline.operators.dealing import spread
from weftline.operators.tagging import edit_script, suffix_features

PARTS = t.PARTS.replace("'", "''")


def tokens_sql(name: str, keys: str, extra: str = "") -> str:
    """CTE tk: keys, sent_id, pos, word of a table's text, by the tokenizer's rules."""
    return rf"""
    tk_l AS (SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS sent_id FROM (SELECT *, string_split(text, chr(10)) AS ls FROM {name} {extra})),
    tk_i AS (SELECT *, list_filter(string_split_regex(line, '[ \t]'), lambda x: x <> '') AS items FROM tk_l),
    tk_k AS (SELECT *, items[len(items)] AS last_item, regexp_extract(items[len(items)], '^[^.!?]*') AS head FROM tk_i WHERE len(items) > 0),
    tk_w AS (SELECT *, list_concat(flatten(list_transform(items[1:len(items) - 1], lambda x: regexp_extract_all(x, '{PARTS}'))),
        CASE WHEN regexp_matches(last_item, '[.!?]\z') AND head <> '' THEN list_append(regexp_extract_all(head, '{PARTS}'), substr(last_item, length(head) + 1))
             WHEN regexp_matches(last_item, '[.!?]\z') THEN [last_item] ELSE regexp_extract_all(last_item, '{PARTS}') END) AS words FROM tk_k),
    tk AS (SELECT {keys}, sent_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM tk_w)"""


#: CTE wd: doc_id, pos, word of documents cut into words and marks.
WORDS_SQL = r"""
    wd_a AS (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}\s]') AS ws FROM documents),
    wd AS (SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM wd_a)"""

IS_PUNCT = "regexp_full_match(word, '[[:punct:]]')"


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, sent_id, pos, word of documents."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("sent_id", "line")).select("doc_id", "lang", "sent_id", F.posexplode(t.tokens_of(F.col("line"))).alias("pos", "word"))


def split_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, pos, word of documents cut into words and marks."""
    return table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(t.split_words(F.col("text"))).alias("pos", "word"))


@query(f"""
    WITH {tokens_sql("documents", "doc_id, lang")},
    n AS (SELECT lang, count(*) AS tokens, sum(CASE WHEN {IS_PUNCT} THEN 1 ELSE 0 END) / count(*) AS punct_share FROM tk GROUP BY lang),
    c AS (SELECT lang, word, count(*) AS n FROM tk GROUP BY lang, word),
    top AS (SELECT lang, word AS top_word, n AS top_count FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) = 1),
    b AS (SELECT lang, word, coalesce(lead(word) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), '_') AS next FROM tk),
    f AS (SELECT b.lang, b.next, count(*) AS n FROM b JOIN top ON b.lang = top.lang AND b.word = top.top_word GROUP BY b.lang, b.next),
    g AS (SELECT lang, next AS top_next, n AS next_count FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, next) = 1)
    SELECT n.lang, tokens, round(punct_share, 6) AS punct_share, top_word, top_count, top_next, round(next_count / top_count, 6) AS next_share FROM n JOIN top USING (lang) JOIN g USING (lang)
""")
def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by language, share of punctuation, the most frequent token and what follows it most often."""
    pairs = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line")).withColumn("w", t.tokens_of(F.col("line")))
    following = F.slice(F.concat("w", F.array(F.lit("_"))), F.lit(2), F.size("w"))
    pairs = pairs.select("lang", F.inline(F.arrays_zip(F.col("w").alias("word"), following.alias("next"))))
    counted = pairs.groupBy("lang", "word", "next").agg(F.count(F.lit(1)).alias("n"))
    less = (-F.col("n")).alias("less")
    by_word = counted.groupBy("lang", "word").agg(F.sum("n").alias("total"), F.min(F.struct(less, "next")).alias("best")).withColumnRenamed("total", "n")
    stats = by_word.groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(p.is_punct(F.col("word")), F.col("n")).otherwise(0)).alias("punct"), F.min(F.struct(less, "word", "best")).alias("top"))
    share = F.round(-F.col("top.best.less") / -F.col("top.less"), 6)
    return stats.select("lang", "tokens", F.round(F.col("punct") / F.col("tokens"), 6).alias("punct_share"), F.col("top.word").alias("top_word"), (-F.col("top.less")).alias("top_count"), F.col("top.best.next").alias("top_next"), share.alias("next_share"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS sentences FROM documents")
def lines_per_document(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x: (F.trim(x) != "") & ~p.is_comment(x))
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("long").alias("lines"), F.size(kept).cast("long").alias("sentences"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    i AS (SELECT doc_id, unnest(list_filter(string_split_regex(line, '[ \t]'), lambda x: x <> '')) AS item FROM l)
    SELECT doc_id, count(*) AS items, count(DISTINCT item) AS distinct_items, CAST(sum(length(item)) AS BIGINT) AS chars FROM i GROUP BY doc_id
""")
def whitespace_items(spark: SparkSession, sf: str) -> DataFrame:
    # Texts are moved once, whole; their items, each with its doc_id, would be far more.
    found = t.items(table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("item").alias("distinct_items"), F.sum(F.char_length("item")).alias("chars"))


@query(f"WITH {WORDS_SQL} SELECT lang, word, count(*) AS n FROM wd GROUP BY lang, word")
def punct_split_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return split_tokens(spark, sf).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {tokens_sql('conversations', 'conv_id, turn')} SELECT conv_id, turn, sent_id, pos, word FROM tk")
def rule_tokens(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    cut = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    return cut.select("conv_id", "turn", F.col("sent_id").cast("long").alias("sent_id"), F.posexplode(t.tokens_of(F.col("line"))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""
    WITH {tokens_sql("documents", "doc_id, lang")}
    SELECT lang, word, {IS_PUNCT} AS is_punct, count(*) AS n FROM tk GROUP BY lang, word
""")
def document_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = doc_tokens(spark, sf).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", "word", p.is_punct(F.col("word")).alias("is_punct"), "n")


@query(rf"""
    WITH {WORDS_SQL}
    SELECT lang, count(*) AS tokens, CAST(sum(CAST({IS_PUNCT} AS INT)) AS BIGINT) AS punct, CAST(sum(CAST(regexp_full_match(word, '[^\p{{L}}\p{{Nd}}]') AS INT)) AS BIGINT) AS marks FROM wd GROUP BY lang
""")
def punct_share_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return split_tokens(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("tokens"), F.sum(p.is_punct(w).cast("int")).alias("punct"), F.sum(p.is_mark(w).cast("int")).alias("marks"))


@query(r"""
    WITH i AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '[ \t\n]'), lambda x: x <> '')) AS word FROM documents)
    SELECT word, upper(substr(word, 1, 1)) = substr(word, 1, 1) AND lower(substr(word, 1, 1)) <> substr(word, 1, 1) AS first_capital, upper(word) = word AND lower(word) <> word AS all_capitals,
      len(list_filter(string_split(word, ''), lambda c: c <> '' AND c = upper(c))) >= 2 AS many_capitals, regexp_matches(word, '[^\p{L}\p{Nd}]') AS has_mark, NOT regexp_matches(word, '[\p{L}\p{Nd}]') AS only_marks,
      regexp_matches(word, '[^\p{L}\p{Nd}]\z') AS ends_with_mark, substr(word, 1, 1) AS first_char, substr(word, -1, 1) AS last_char, regexp_full_match(regexp_replace(word, '[.,-]', '', 'g'), '[0-9]+') AS is_numeric
    FROM i
""")
def word_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Capital, mark, number and edge predicates of every distinct item."""
    w = F.col("word")
    items = table(spark, sf, "documents").select(F.explode(F.filter(F.split("text", "[ \t\n]"), lambda x: x != "")).alias("word")).distinct()
    return items.select(
        "word", p.first_is_capital(w).alias("first_capital"), p.all_capitals(w).alias("all_capitals"), p.many_capitals(w).alias("many_capitals"), p.has_mark(w).alias("has_mark"), p.only_marks(w).alias("only_marks"),
        p.ends_with_mark(w).alias("ends_with_mark"), p.first_char(w).alias("first_char"), p.last_char(w).alias("last_char"), p.is_numeric(w).alias("is_numeric"),
    )


#: The same entities as SQL spells them, each part written out. Characters that end one entity and stand before the next are doubled in
#: the text first, since RE2 can't look ahead; so a blank inside an entity is two here.
_INT = "(?:[0-9]{1,3}(?:(?:[.]|  )[0-9]{3})+|[0-9]+)"
_NUM = f"(?:{_INT},[0-9]+|{_INT})"
_DAY, _MON, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:1[0-9][0-9][0-9]|20[0-9][0-9])"
_DATE = f"(?:{_DAY}  (?:January|February|March|April|May|June|July|August|September|October|November|December)  {_YEAR}|{_DAY}[-./]{_MON}[-./]{_YEAR}|{_YEAR}[-./]{_MON}[-./]{_DAY})"
_MONEY = f"{_NUM}(?:  )?(?:EUR|USD|GBP|RON|CHF|HUF|euro|dollars|pounds)"
_WHO = "(?:[A-Z][.]  )?[A-Z][a-z]+(?:  [A-Z][a-z]+)?"
_HUN, _TEN, _ONE = "(?:CM|CD|DC|DCC|DCCC|CCC|CC|C|D)", "(?:XC|XL|LXXX|LXX|LX|XXX|XX|X|L)", "(?:IX|IV|VIII|VII|VI|III|II|I|V)"
ENTITY_SQL = {
    "integer": _INT, "real": f"{_INT},[0-9]+", "percent": f"{_NUM}(?:  )?%", "number_word": "one|two|three|four|five|six|seven|eight|nine|ten|twenty|hundred|thousand|million", "money": _MONEY, "date": _DATE, "year": _YEAR,
    "time": "(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?:(?:  )?[ap]m|(?:  )?[AP]M)?", "duration": f"{_NUM}(?:  )?(?:seconds|minutes|hours|days|months|years|min|s|h)", "distance": f"{_NUM}(?:  )?(?:miles|inches|[kcm]?m)", "area": f"{_NUM}(?:  )?(?:hectares|acres|ha)",
    "mass": f"{_NUM}(?:  )?(?:tonnes|[mk]?g|t)", "volume": f"{_NUM}(?:  )?(?:litres|ml|cc|l)", "initials": "[A-Z][.](?:[A-Z][.])*", "male": f"(?:Mr|Sir)[.]?  {_WHO}", "female": f"(?:Mrs|Ms|Miss|Madam)[.]?  {_WHO}", "person": f"(?:Dr|Prof|Gen|Col)[.]  {_WHO}",
    "name": "[A-Z][a-z]+(?:  [A-Z][a-z]+)+", "junior": "[A-Z][a-z]+(?:  [A-Z][a-z]+)+,?  Jr[.]", "roman": f"(?:MMM|MM|M){_HUN}?{_TEN}?{_ONE}?|{_HUN}{_TEN}?{_ONE}?|{_TEN}{_ONE}?|{_ONE}",
    "email": "[-A-Za-z0-9._%+]+@[-A-Za-z0-9]+(?:[.][-A-Za-z0-9]+)+", "url": "(?:http://|https://|ftp://|www[.])[-A-Za-z0-9.]+(?::[0-9]+)?(?:/[-A-Za-z0-9._~/%+]*)?", "code": "[0-9]+/[0-9]+(?:/[A-Z][A-Z])?",
    "phone": "[+]?[0-9]{1,3}(?:  |-)[0-9]{3}(?:  |-)[0-9]{3,4}(?:(?:  |-)[0-9]{4})?",
}
DOUBLED_SQL = r"d AS (SELECT doc_id, regexp_replace(text, '([ \t\n\f\r;!?)])', '\1\1', 'g') AS text FROM documents)"


def _sql_match(body: str, group: int) -> str:
    return rf"regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.,/@:-]){body}(?:[.,;:!?)]|[ \t\n\f\r]|$)', {group})"


def _entities_sql() -> str:
    each = (f"SELECT doc_id, '{k}' AS kind, replace(unnest({_sql_match(f'({x})', 1)}), '  ', ' ') AS entity FROM d" for k, x in ENTITY_SQL.items())
    return f"WITH {DOUBLED_SQL} SELECT doc_id, kind, entity, count(*) AS n FROM ({' UNION ALL '.join(each)}) GROUP BY doc_id, kind, entity"


@query(_entities_sql())
def pattern_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, money, dates, times, amounts, names, addresses and codes of every document."""
    return e.entities(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")).groupBy("doc_id", "kind", "entity").agg(F.count(F.lit(1)).alias("n"))


def _ranges_sql(kinds: dict[str, str]) -> str:
    each = (f"SELECT doc_id, '{k}' AS kind, unnest({_sql_match(f'({x})(?:  )?-(?:  )?({x})', 1)}) AS lo, unnest({_sql_match(f'({x})(?:  )?-(?:  )?({x})', 2)}) AS hi FROM d" for k, x in kinds.items())
    return f"WITH {DOUBLED_SQL} SELECT doc_id, kind, replace(lo, '  ', ' ') AS lo, replace(hi, '  ', ' ') AS hi FROM ({' UNION ALL '.join(each)})"


@query(f"SELECT doc_id, lo, hi FROM ({_ranges_sql({'number': _NUM})})")
def number_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return e.ranges(table(spark, sf, "documents"), "number")


@query(_ranges_sql({k: ENTITY_SQL[k] for k in e.RANGES}))
def closed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of integers, reals, percents, dates and amounts of money."""
    docs = table(spark, sf, "documents")
    found = [e.ranges(docs, k).select("doc_id", F.lit(k).alias("kind"), "lo", "hi") for k in e.RANGES]
    return reduce(DataFrame.unionByName, found)


@query(
    f"SELECT id, kind, text AS entity FROM (WITH d AS (SELECT o_orderkey AS id, 'A ' || o_orderdate::DATE || ' 5 6 7 9; 1.250,5 RON! Dr. Ana Pop X XX XL C M MCMXCIX I.O. 14:05 pm? ' || o_orderkey || '/12/CE (12 km) www.a.b 3 kg 4 ml 2 ha Mrs. E. Hill Sir Tom Ray, Jr.' AS t FROM orders), "
    "x AS (SELECT id, t FROM d) SELECT id, kind, unnest(found) AS text FROM (SELECT id, t, 'date' AS kind, [substr(t, 3, 10)] AS found FROM x UNION ALL SELECT id, t, 'roman', ['X', 'XX', 'XL', 'C', 'M', 'MCMXCIX', 'I'] FROM x UNION ALL SELECT id, t, 'money', ['1.250,5 RON'] FROM x UNION ALL SELECT id, t, 'time', ['14:05 pm'] FROM x "
    "UNION ALL SELECT id, t, 'code', [id || '/12/CE'] FROM x UNION ALL SELECT id, t, 'distance', ['12 km'] FROM x UNION ALL SELECT id, t, 'mass', ['3 kg'] FROM x UNION ALL SELECT id, t, 'volume', ['4 ml'] FROM x UNION ALL SELECT id, t, 'area', ['2 ha'] FROM x UNION ALL SELECT id, t, 'person', ['Dr. Ana Pop'] FROM x "
    "UNION ALL SELECT id, t, 'female', ['Mrs. E. Hill Sir'] FROM x UNION ALL SELECT id, t, 'junior', ['Hill Sir Tom Ray, Jr.'] FROM x UNION ALL SELECT id, t, 'url', ['www.a.b'] FROM x UNION ALL SELECT id, t, 'initials', ['I.O.', 'E.'] FROM x))"
)
def written_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of a sentence that is written for each order, so that every one of them is known."""
    tail = " 5 6 7 9; 1.250,5 RON! Dr. Ana Pop X XX XL C M MCMXCIX I.O. 14:05 pm? "
    text = F.concat(F.lit("A "), F.col("o_orderdate").cast("date").cast("string"), F.lit(tail), F.col("o_orderkey").cast("string"), F.lit("/12/CE (12 km) www.a.b 3 kg 4 ml 2 ha Mrs. E. Hill Sir Tom Ray, Jr."))
    kinds = ("date", "roman", "money", "time", "code", "distance", "mass", "volume", "area", "person", "female", "junior", "url", "initials")
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return e.entities(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), kinds).withColumnRenamed("doc_id", "id")


@query(rf"""
    WITH {WORDS_SQL}, w AS (SELECT DISTINCT lower(word) AS word FROM wd WHERE regexp_matches(word, '\p{{L}}'))
    SELECT word, list_aggregate(list_transform([0,1,2,3,4,5,6], lambda i: 'e' || i || ':' || CASE WHEN length(word) > i THEN substr(word, length(word) - i, 1) ELSE '_' END), 'string_agg', ' ') AS feats FROM w
""")
def suffix_bags(spark: SparkSession, sf: str) -> DataFrame:
    words = split_tokens(spark, sf).filter(F.col("word").rlike(r"\p{L}")).select(F.lower("word").alias("word")).distinct()
    return words.select("word", F.array_join(suffix_features(F.col("word")), " ").alias("feats"))


LETTERS_SQL = rf"""{WORDS_SQL}, dw AS (SELECT DISTINCT lower(word) AS word FROM wd WHERE regexp_matches(word, '\p{{L}}')),
    ch AS (SELECT word, unnest(range(length(word))) AS ix FROM dw)"""


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    words = split_tokens(spark, sf).filter(F.col("word").rlike(r"\p{L}")).select(F.lower("word").alias("word")).distinct()
    return t.characters(words)


@query(f"""
    WITH {LETTERS_SQL}
    SELECT word, ix AS char_pos, {", ".join(f"CASE WHEN ix + ({k}) BETWEEN 0 AND length(word) - 1 THEN substr(word, ix + ({k}) + 1, 1) ELSE '_' END AS {'m' if k < 0 else 'p'}{abs(k)}" for k in range(-3, 4))} FROM ch
""")
def letter_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Three letters on each side of every letter of every distinct word."""
    at = F.col("char_pos")
    return _letters(spark, sf).select("word", at.cast("long").alias("char_pos"), *(c.alias(f"{'m' if k < 0 else 'p'}{abs(k)}") for k, c in zip(range(-3, 4), letter_context(F.col("word"), at, 3), strict=True)))


@query(f"""
    WITH {LETTERS_SQL}, c AS (SELECT word, ix, substr(word, ix + 1, 1) AS ch FROM ch)
    SELECT word, ix AS char_pos, ch AS char, CASE WHEN ix = 0 THEN '#' WHEN ix = 1 THEN 'pau' ELSE lag(ch, 2) OVER w END AS char_m2, CASE WHEN ix = 0 THEN 'pau' ELSE lag(ch, 1) OVER w END AS char_m1,
      coalesce(lead(ch, 1) OVER w, '#') AS char_p1, coalesce(lead(ch, 2) OVER w, '#') AS char_p2 FROM c WINDOW w AS (PARTITION BY word ORDER BY ix)
""")
def quinphone_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Two letters on each side, a pause before the first."""
    out = quinphones(_letters(spark, sf), "char", Window.partitionBy("word").orderBy("char_pos"), first_after="pau")
    return out.withColumn("char_pos", F.col("char_pos").cast("long"))


@query(f"""
    WITH {tokens_sql("conversations", "conv_id, turn")}
    SELECT conv_id, turn, sent_id, pos, word, coalesce(lag(word, 2) OVER w, '_') AS word_m2, coalesce(lag(word, 1) OVER w, '_') AS word_m1, coalesce(lead(word, 1) OVER w, '_') AS word_p1, coalesce(lead(word, 2) OVER w, '_') AS word_p2
    FROM tk WINDOW w AS (PARTITION BY conv_id, turn, sent_id ORDER BY pos)
""")
def word_contexts(spark: SparkSession, sf: str) -> DataFrame:
    cut = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    words = cut.select("conv_id", "turn", F.col("sent_id").cast("long").alias("sent_id"), t.tokens_of(F.col("line")).alias("words"))
    return words.select("conv_id", "turn", "sent_id", F.inline(neighbours_in(F.col("words"), 2, 2, "_")))


@query(f"""
    WITH {tokens_sql("documents", "doc_id")},
    q AS (SELECT *, CAST(sum(CASE WHEN word IN ('"', '``', '''''') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) % 2 = 1 AS in_quote FROM tk)
    SELECT doc_id, in_quote, count(*) AS tokens FROM q GROUP BY doc_id, in_quote
""")
def quoted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    held = doc_tokens(spark, sf).select("doc_id", "sent_id", "pos", "word")
    return quote_state(held, p.is_quote(F.col("word")), ["doc_id", "sent_id"], "pos").groupBy("doc_id", "in_quote").agg(F.count(F.lit(1)).alias("tokens"))


@query(f"""
    WITH {tokens_sql("documents", "doc_id")},
    s AS (SELECT doc_id, sent_id, word, pos, coalesce(lag(word) OVER w, '_') AS prev, lead(word) OVER w IS NULL AS last FROM tk WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
    b AS (SELECT prev, word AS next FROM s UNION ALL SELECT word, '_' FROM s WHERE last),
    c AS (SELECT prev, next, count(*) AS n FROM b GROUP BY prev, next)
    SELECT prev, next, n, round(n / sum(n) OVER (PARTITION BY prev), 6) AS p FROM c
""")
def bigram_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and conditional probabilities of neighbouring tokens, sentence edges included."""
    cut = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(t.tokens_of(F.col("line")).alias("words"))
    return conditional(bigrams_in(cut, "words"), ["prev"]).withColumn("p", F.round("p", 6))


@query(rf"""
    WITH {WORDS_SQL}, w AS (SELECT DISTINCT word FROM wd WHERE regexp_full_match(word, '\p{{L}}+')),
    k AS (SELECT word, lower(word) AS lemma FROM w WHERE lower(word) <> word),
    n AS (SELECT word, lemma, len(list_filter(range(1, least(length(word), length(lemma)) + 1), lambda i: substr(word, 1, i) = substr(lemma, 1, i))) AS shared FROM k)
    SELECT word, lemma, (length(word) - shared) || '|' || substr(lemma, shared + 1) AS script FROM n
""")
def edit_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """What turns a capitalised word into its lower-case form: letters off the end, and on."""
    words = split_tokens(spark, sf).filter(F.col("word").rlike(r"^\p{L}+\z")).select("word").distinct().withColumn("lemma", F.lower("word")).filter("lemma <> word")
    return words.select("word", "lemma", edit_script(F.col("word"), F.col("lemma")).alias("script"))


@query(rf"""
    WITH {WORDS_SQL}, w AS (SELECT DISTINCT word FROM wd),
    r AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS rank FROM w)
    SELECT word, rank, CASE WHEN rank % 10 = 0 THEN 'test' ELSE 'train' END AS part FROM r
""")
def modulo_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth distinct token, in order, for testing."""
    ranked = dense_order(split_tokens(spark, sf).select("word").distinct(), "word")
    return ranked.withColumn("part", F.when(F.col("rank") % 10 == 0, "test").otherwise("train"))


@query(r"""
    WITH s AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+') AS parts FROM documents),
    u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
    o AS (SELECT doc_id, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM u)
    SELECT doc_id, count(*) AS words, CAST(sum(stop - length(part)) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS stops FROM o WHERE regexp_matches(part, '^[\p{L}\p{Nd}_]') GROUP BY doc_id
""")
def word_span_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Words with offsets: how many, and the sums of their starts and stops, for each document."""
    spans = t.word_spans(table(spark, sf, "documents").select("doc_id", "text"))
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"))


@query(r"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[^\x20-\x7e]', '', 'g'), '\\.{0,3}', '', 'g'))) AS ascii_sha, sha256(replace(text, ' ', '_')) AS joined_sha, length(list_aggregate(string_split_regex(text, '\s+'), 'string_agg', ' ')) AS joined_chars FROM documents
""")
def text_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the text in ASCII and with underscores, and its length with single blanks."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(ascii_only(text), 256).alias("ascii_sha"), F.sha2(underscored(text), 256).alias("joined_sha"), F.char_length(t.join_words(F.split(text, r"\s+"))).cast("long").alias("joined_chars"))


@query("""
    WITH n AS (SELECT n_nationkey AS k, n_name AS word FROM nation)
    SELECT k, word, CASE WHEN regexp_matches(word, 'IA$') THEN 'land' WHEN regexp_matches(word, '^U') THEN 'union' WHEN regexp_matches(word, 'A.A') THEN 'a-a' ELSE 'other' END AS class,
      regexp_matches(word, 'A.A') OR regexp_matches(word, 'N.T') AS question, regexp_matches(word, 'A.A.') OR regexp_matches(word, 'N.T.') AS question_compat FROM n
""")
def pattern_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """First matching pattern, and wildcard questions, with and without the final alignment."""
    w = F.col("word")
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("word"))
    cascade = [("IA$", F.lit("land")), ("^U", F.lit("union")), ("A.A", F.lit("a-a"))]
    return names.select("k", "word", p.first_match(w, cascade, F.lit("other")).alias("class"), p.answers_question(w, ["A*A", "N*T"]).alias("question"), p.answers_question(w, ["A*A", "N*T"], skip_final=True).alias("question_compat"))
