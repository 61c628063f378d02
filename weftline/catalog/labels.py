"""Sentences to labels, states, frames and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog.registry import query, table
from weftline.catalog.text import IS_PUNCT, rule_tokens, tokens_sql
from weftline.functions.predicates import is_punct
from weftline.functions.text import SYLLABLE, syllables
from weftline.operators import acoustic as a
from weftline.operators.context import distance_to_flag, distance_to_marks, place_in_group
from weftline.operators.counts import sentence_totals, sentence_type
from weftline.operators.dealing import spread
from weftline.operators.labels import sentence_labels
from weftline.operators.tokenize import tokens_of
from weftline.plans.synthesis import speak, state_parameters
from weftline.sources.sinks import lexicon_line, token_line

SENT = ["conv_id", "turn", "sent_id"]
KEYS = "conv_id, turn, sent_id"
TOKENS_SQL = tokens_sql("conversations", "conv_id, turn")
@query(f"""
    WITH {TOKENS_SQL}, s AS (SELECT *, CASE WHEN {IS_PUNCT} THEN 0 ELSE len(regexp_extract_all(word, '{SYLLABLE}')) END AS sy FROM tk)
    SELECT {KEYS}, count(*) AS words, CAST(sum(sy) AS BIGINT) AS syllables, CAST(sum(CASE WHEN sy > 1 THEN 1 ELSE 0 END) AS BIGINT) AS stressed FROM s GROUP BY ALL
""")
def sentence_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Words, syllables and stressed syllables of every sentence."""
    n = F.when(is_punct(F.col("word")), 0).otherwise(F.size(syllables(F.col("word"))))
    return sentence_totals(rule_tokens(spark, sf).withColumn("n", n), SENT, F.col("n"), (F.col("n") > 1).cast("int"))


@query(f"""
    WITH {TOKENS_SQL} SELECT {KEYS}, coalesce(arg_min(CASE word WHEN '?' THEN 'question' WHEN '!' THEN 'exclamation' END, CASE WHEN word IN ('?', '!') THEN pos END), 'statement') AS sentence_type FROM tk GROUP BY ALL
""")
def sentence_types(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_type(rule_tokens(spark, sf), SENT, "word", "pos")


@query(f"""
    WITH {TOKENS_SQL}, m AS (SELECT {KEYS}, pos, word, CASE WHEN {IS_PUNCT} THEN word END AS mark, length(word) AS weight FROM tk),
    t AS (SELECT *, row_number() OVER w AS rn, sum(weight) OVER (PARTITION BY {KEYS} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY {KEYS}) AS nr, sum(weight) OVER (PARTITION BY {KEYS}) AS tot FROM m WINDOW w AS (PARTITION BY {KEYS} ORDER BY pos)),
    d AS (SELECT *, last_value(mark IGNORE NULLS) OVER b AS pk, last_value(CASE WHEN mark IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pr, last_value(CASE WHEN mark IS NOT NULL THEN run END IGNORE NULLS) OVER b AS pw,
      first_value(mark IGNORE NULLS) OVER f AS nk, first_value(CASE WHEN mark IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS nx, first_value(CASE WHEN mark IS NOT NULL THEN run END IGNORE NULLS) OVER f AS nw FROM t
      WINDOW b AS (PARTITION BY {KEYS} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY {KEYS} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT {KEYS}, pos, word, coalesce(pk, 'sent_start') AS prev_kind, CAST(rn - coalesce(pr, 0) AS BIGINT) AS prev_rows, CAST(run - coalesce(pw, 0) AS BIGINT) AS prev_weight, coalesce(nk, 'sent_start') AS next_kind,
      CAST(coalesce(nx, nr + 1) - rn AS BIGINT) AS next_rows, CAST(coalesce(nw, tot) - run AS BIGINT) AS next_weight FROM d
""")
def mark_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every token to the punctuation before and after it, in tokens and in characters."""
    rows = rule_tokens(spark, sf).withColumns({"mark": F.when(is_punct(F.col("word")), F.col("word")), "weight": F.char_length("word")})
    out = distance_to_marks(rows, "mark", "weight", SENT, "pos").drop("mark", "weight")
    return out.withColumns({c: F.col(c).cast("long") for c in ("prev_rows", "prev_weight", "next_rows", "next_weight")})


@query(f"""
    WITH {TOKENS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY pos) AS rn, length(word) > 6 AS long FROM tk),
    d AS (SELECT *, last_value(CASE WHEN long THEN rn END IGNORE NULLS) OVER b AS p, first_value(CASE WHEN long THEN rn END IGNORE NULLS) OVER f AS x, count(*) OVER (PARTITION BY {KEYS}) AS nr FROM n
      WINDOW b AS (PARTITION BY {KEYS} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY {KEYS} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT {KEYS}, pos, CAST(coalesce(rn - p, -1) AS BIGINT) AS prev_flag, CAST(coalesce(x - rn, -1) AS BIGINT) AS next_flag, rn AS index, nr AS of, CASE WHEN nr = 1 THEN 'single' WHEN rn = 1 THEN 'start' WHEN rn = nr THEN 'end' ELSE 'mid' END AS place FROM d
""")
def flag_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distance to the nearest long token on each side, and the token's place in its sentence."""
    rows = place_in_group(rule_tokens(spark, sf), SENT, "pos")
    out = distance_to_flag(rows, F.char_length("word") > 6, SENT, "pos")
    return out.select(*SENT, "pos", F.col("prev_flag").cast("long").alias("prev_flag"), F.col("next_flag").cast("long").alias("next_flag"), F.col("index").cast("long").alias("index"), "of", "place")


def annotated_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, sent_id, tokens: the same, a sentence's tokens as an array in order. Lines move once, as text; lines of one number, as of turns that are repeated, are one sentence."""
    turns = table(spark, sf, "conversations")
    cut = turns.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    held = cut.select("doc_id", (F.col("turn") * 10_000 + F.col("line_no").cast("long")).alias("sent_id"), "line").transform(spread, "doc_id", "sent_id").groupBy("doc_id", "sent_id").agg(F.collect_list("line").alias("lines"))
    placed = F.flatten(F.transform("lines", lambda line: F.transform(tokens_of(line), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))))
    found = held.select("doc_id", "sent_id", F.array_sort(placed).alias("placed"))
    parts = lambda w: F.when(is_punct(w), F.array(w)).otherwise(F.transform(syllables(w), F.lower))
    cut_up = F.transform("placed", lambda t: F.struct(t["word"].alias("word"), parts(t["word"]).alias("syllables")))
    stress = lambda s: F.transform(s, lambda _, i: F.when((i == 0) & (F.size(s) > 1), 1).otherwise(0))
    letters = lambda s: F.transform(s, lambda x: F.filter(F.split(x, ""), lambda c: (c != "") & c.rlike(r"\p{L}")))
    phones = lambda t: F.when(is_punct(t["word"]), F.array(F.array(F.when(t["word"] == ",", "sp").otherwise("pau")))).otherwise(letters(t["syllables"]))
    rows = found.select("doc_id", "sent_id", cut_up.alias("cut"))
    return rows.select("doc_id", "sent_id", F.transform("cut", lambda t: F.struct(t["word"].alias("word"), t["syllables"].alias("syllables"), stress(t["syllables"]).alias("stress"), phones(t).alias("phones"))).alias("tokens"))


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, sent_id, pos, word, syllables, stress, phones of conversations, by the vowel rule; letters stand for phones."""
    found = syllables(F.col("word"))
    rows = rule_tokens(spark, sf).withColumn("syllables", F.when(is_punct(F.col("word")), F.array("word")).otherwise(F.transform(found, F.lower)))
    stress = F.transform("syllables", lambda s, i: F.when((i == 0) & (F.size("syllables") > 1), 1).otherwise(0))
    phones = F.when(is_punct(F.col("word")), F.array(F.array(F.when(F.col("word") == ",", "sp").otherwise("pau")))).otherwise(F.transform("syllables", lambda s: F.filter(F.split(s, ""), lambda c: (c != "") & c.rlike(r"\p{L}"))))
    return rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 10_000 + F.col("sent_id")).alias("sent_id"), "pos", "word", "syllables", stress.alias("stress"), phones.alias("phones"))


QUOTES_SQL = "('\"', '``', '''''')"
#: CTEs up to lb: doc_id, sent_id, phone_no, label of every phone. Tokens with a full stop put behind each sentence, what labels are made of
#: and quotes (ak), the state of quotes (aq), distances to marks (am), syllables (ay) with distances to stressed ones (af), phones (ap).
LABELS_SQL = rf"""{TOKENS_SQL},
    a0 AS (SELECT conv_id AS doc_id, turn * 10000 + sent_id AS sent_id, pos, word, {IS_PUNCT} AS pu FROM tk),
    a1 AS (SELECT doc_id, sent_id, pos, word, pu, CASE WHEN pu THEN [word] ELSE list_transform(regexp_extract_all(word, '{SYLLABLE}'), lambda x: lower(x)) END AS sy FROM a0 UNION ALL SELECT doc_id, sent_id, max(pos) + 1, '.', true, ['.'] FROM a0 GROUP BY ALL),
    ak AS (SELECT *, word IN {QUOTES_SQL} AS qu FROM a1 WHERE NOT pu OR word IN ('.', ',', '!', '?') OR word IN {QUOTES_SQL}),
    aq AS (SELECT *, sum(CAST(qu AS INT)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) % 2 AS quote FROM ak),
    ar AS (SELECT *, CASE WHEN pu THEN word END AS mark, CASE WHEN pu THEN 0 ELSE len(sy) END AS ns, CASE WHEN NOT pu AND len(sy) > 1 THEN 1 ELSE 0 END AS nst, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS rn FROM aq WHERE NOT qu),
    aw AS (SELECT *, sum(ns) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER p AS nr, sum(ns) OVER p AS tsyl, sum(nst) OVER p AS tstress,
      count(mark) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span, arg_min(CASE word WHEN '?' THEN 'q' WHEN '!' THEN 'e' END, pos) FILTER (word IN ('?', '!')) OVER p AS kind FROM ar WINDOW p AS (PARTITION BY doc_id, sent_id)),
    am AS (SELECT *, last_value(mark IGNORE NULLS) OVER b AS pk, last_value(CASE WHEN mark IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS px, last_value(CASE WHEN mark IS NOT NULL THEN run END IGNORE NULLS) OVER b AS pw,
      first_value(mark IGNORE NULLS) OVER f AS nk, first_value(CASE WHEN mark IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS nx, first_value(CASE WHEN mark IS NOT NULL THEN run END IGNORE NULLS) OVER f AS nw FROM aw
      WINDOW b AS (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    ay AS (SELECT *, unnest(sy) AS s, generate_subscripts(sy, 1) - 1 AS syl FROM am),
    aa AS (SELECT *, CASE WHEN NOT pu AND len(sy) > 1 AND syl = 0 THEN 1 ELSE 0 END AS st, CASE WHEN pu AND word = ',' THEN ['sp'] WHEN pu THEN ['pau'] ELSE list_filter(string_split(s, ''), lambda c: regexp_matches(c, '\p{{L}}')) END AS ph, row_number() OVER (PARTITION BY doc_id, sent_id, span ORDER BY pos, syl) AS sn FROM ay),
    af AS (SELECT *, coalesce(sn - last_value(CASE WHEN st = 1 THEN sn END IGNORE NULLS) OVER b, -1) AS pst, coalesce(first_value(CASE WHEN st = 1 THEN sn END IGNORE NULLS) OVER f - sn, -1) AS nst2 FROM aa
      WINDOW b AS (PARTITION BY doc_id, sent_id, span ORDER BY pos, syl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY doc_id, sent_id, span ORDER BY pos, syl ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    ap AS (SELECT *, unnest(ph) AS phone, generate_subscripts(ph, 1) AS phpos FROM af), an AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos, syl, phpos) AS no FROM ap),
    lb AS (SELECT doc_id, sent_id, CAST(no - 1 AS INT) AS phone_no, CASE WHEN no = 2 THEN 'pau' ELSE lag(phone, 2, '#') OVER w END || '^' || CASE WHEN no = 1 THEN 'pau' ELSE lag(phone, 1, '#') OVER w END || '-' || phone || '+' || lead(phone, 1, '#') OVER w || '=' || lead(phone, 2, '#') OVER w
      || '/SYLPOS:' || CASE WHEN greatest(ns, 1) = 1 THEN 'single' WHEN syl = 0 THEN 'start' WHEN syl = ns - 1 THEN 'end' ELSE 'mid' END || '/PHPOS:' || phpos || '/NPIS:' || len(ph) || '/STRESS:' || st || '/PREVSTRESS:' || pst || '/NEXTSTRESS:' || nst2
      || '/PREVMARK:' || coalesce(pk, 'sent_start') || '/PREVWORDS:' || (rn - coalesce(px, 0)) || '/PREVSYL:' || (run - coalesce(pw, 0)) || '/NEXTMARK:' || coalesce(nk, 'sent_start') || '/NEXTWORDS:' || (coalesce(nx, nr + 1) - rn) || '/NEXTSYL:' || (coalesce(nw, tsyl) - run)
      || '/QUOTE:' || quote || '/TYPE:' || coalesce(kind, 's') || '/TWORDS:' || nr || '/TSYL:' || tsyl || '/TSTRESS:' || tstress AS label FROM an WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY no))"""


@query(f"WITH {LABELS_SQL} SELECT doc_id, sent_id, phone_no, label FROM lb")
def context_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Full-context labels of every phone of the conversations."""
    return sentence_labels(annotated_sentences(spark, sf))


@query(f"""
    WITH {TOKENS_SQL}, s AS (SELECT conv_id, turn, sent_id, pos, word, CASE WHEN {IS_PUNCT} THEN [word] ELSE list_transform(regexp_extract_all(word, '{SYLLABLE}'), lambda x: lower(x)) END AS sy FROM tk)
    SELECT conv_id AS doc_id, turn * 10000 + sent_id AS sent_id, pos, word || chr(9) || list_aggregate(list_transform(sy, lambda x, i: CASE WHEN i = 1 AND len(sy) > 1 THEN '''' || x ELSE x END), 'string_agg', '-') AS line FROM s
""")
def token_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The tab-separated dump of every token with its syllables."""
    rows = annotated(spark, sf).drop("phones")
    return rows.select("doc_id", "sent_id", "pos", token_line(rows).alias("line"))


@query(f"""
    WITH {TOKENS_SQL}, w AS (SELECT DISTINCT lower(word) AS word FROM tk WHERE NOT {IS_PUNCT})
    SELECT word || chr(9) || list_aggregate(list_filter(string_split(word, ''), lambda c: c <> ''), 'string_agg', ' ') AS line FROM w
""")
def lexicon_lines(spark: SparkSession, sf: str) -> DataFrame:
    """word and phonemes of every distinct word; letters stand for phonemes."""
    words = rule_tokens(spark, sf).filter(~is_punct(F.col("word"))).select(F.lower("word").alias("word")).distinct()
    return words.select(lexicon_line(F.col("word"), F.filter(F.split("word", ""), lambda c: c != "")).alias("line"))


#: A small model: questions on labels, one tree for each of three states.
TREES = """
QS vowel { "*-a+*","*-e+*","*-i+*","*-o+*","*-u+*" }
QS stressed { "/STRESS:1" }
QS pause { "-pau+","-sp+" }

{*}[2]
{
 0 vowel -1 "s2_vowel"
 -1 pause "s2_other" "s2_pause"
}

{*}[3]
{
 0 stressed -1 "s3_stressed"
 -1 pause "s3_plain" "s3_pause"
}

{*}[4]
"s4_all"
"""


@query(f"""
    WITH {LABELS_SQL}, qs AS (SELECT *, regexp_matches(label, '(?s).-[aeiou]\\+.') AS vowel, contains(label, '/STRESS:1') AS stressed, contains(label, '-pau+') OR contains(label, '-sp+') AS pause FROM lb),
    lf AS (SELECT doc_id, sent_id, phone_no, state, CASE state WHEN 2 THEN CASE WHEN vowel THEN 's2_vowel' WHEN pause THEN 's2_pause' ELSE 's2_other' END WHEN 3 THEN CASE WHEN stressed THEN 's3_stressed' WHEN pause THEN 's3_pause' ELSE 's3_plain' END ELSE 's4_all' END AS leaf FROM qs, (VALUES (2), (3), (4)) s(state)),
    de AS (SELECT * FROM (VALUES ('s2_vowel', 5.0::DOUBLE, 0.9), ('s2_other', 4.5, 0.6), ('s2_pause', 0.0, 0.0), ('s3_stressed', 5.4, 0.95), ('s3_plain', 4.8, 0.8), ('s3_pause', 0.0, 0.1), ('s4_all', 4.6, 0.5)) d(leaf, mean, weight))
    SELECT doc_id, sent_id, phone_no, state, leaf, CASE WHEN weight < 0.55 THEN 0.0::DOUBLE ELSE mean END AS pitch, CAST(floor(mean + 0.5) AS INT) AS frames FROM lf JOIN de USING (leaf)
""")
def acoustic_frames(spark: SparkSession, sf: str) -> DataFrame:
    """For every label, state and leaf: mean, frames, voicing; generated from a small model."""
    trees = a.parse_trees(TREES)
    labels = context_labels(spark, sf).withColumn("answers", a.asked(F.col("label"), a.asked_patterns(trees)))
    states = a.expand_states(labels, 3).withColumn("clamped", a.safe_states(F.col("state"), 4))
    leaves = a.tree_leaf(states, "label", trees, "clamped", answers="answers")
    table_ = [("lf0", 2, "s2_vowel", 5.0, 0.2, 0.9), ("lf0", 2, "s2_other", 4.5, 0.3, 0.6), ("lf0", 2, "s2_pause", 0.0, 1.0, 0.0), ("lf0", 3, "s3_stressed", 5.4, 0.1, 0.95), ("lf0", 3, "s3_plain", 4.8, 0.2, 0.8), ("lf0", 3, "s3_pause", 0.0, 1.0, 0.1), ("lf0", 4, "s4_all", 4.6, 0.4, 0.5)]
    densities = spark.createDataFrame(table_, "stream string, state int, leaf string, mean double, var double, weight double")
    found = a.look_up_densities(leaves, densities, "lf0")
    return found.select("doc_id", "sent_id", "phone_no", "state", "leaf", a.voiced_pitch(F.col("mean"), F.col("weight"), 0.55).alias("pitch"), a.state_frames(F.col("mean")).alias("frames"))


#: Trees of a voice of seven streams and its switch, after the questions of TREES.
STREAM_TREES = {
    "dur": '{*}[2]\n{\n 0 vowel -1 "d_vowel"\n -1 pause "d_other" "d_pause"\n}\n',
    "lf0": '{*}[2]\n{\n 0 vowel "p_other" "p_vowel"\n}\n{*}[3]\n{\n 0 stressed "p_plain" "p_stressed"\n}\n',
    "mgc": '{*}[2]\n{\n 0 vowel -1 "m_vowel"\n -1 pause "m_other" "m_pause"\n}\n',
    "bap": '{*}[2]\n{\n 0 pause "b_sound" "b_pause"\n}\n',
    "gv-lf0": '{*}[2]\n"v_lf0"\n',
    "gv-mgc": '{*}[2]\n{\n 0 stressed "v_plain" "v_stressed"\n}\n',
    "gv-bap": '{*}[2]\n"v_bap"\n',
    "switch": '{*}[2]\n{\n 0 pause "gv-switch_2" "gv-switch_1"\n}\n',
}
#: stream, state, leaf, mean, var, weight.
STREAM_DENSITIES = [
    ("dur", 2, "d_vowel", [3.5, 6.4, 2.0], [1.0, 1.0, 1.0], None), ("dur", 2, "d_other", [2.2, 4.5, 1.0], [1.0, 1.0, 1.0], None), ("dur", 2, "d_pause", [8.0, 0.2, 8.0], [1.0, 1.0, 1.0], None),
    ("lf0", 2, "p_vowel", [4.8, 0.25, -0.5], [0.1, 0.2, 0.3], 0.9), ("lf0", 2, "p_other", [4.6, 0.125, 0.5], [0.1, 0.2, 0.3], 0.2), ("lf0", 3, "p_stressed", [5.0, 0.5, 0.25], [0.2, 0.2, 0.2], 0.95), ("lf0", 3, "p_plain", [4.7, 0.0, 0.0], [0.3, 0.2, 0.1], 0.5),
    ("mgc", 2, "m_vowel", [1.5, 0.5, 0.25, 0.75, 0.0, 0.0], [0.1] * 6, None), ("mgc", 2, "m_other", [0.5, -0.25, 0.5, 0.125, 0.0, 0.0], [0.2] * 6, None), ("mgc", 2, "m_pause", [-4.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.3] * 6, None),
    ("bap", 2, "b_sound", [-3.0, 0.5, 0.0], [0.2, 0.1, 0.1], None), ("bap", 2, "b_pause", [0.0, 0.0, 0.0], [0.5, 0.1, 0.1], None),
    ("gv-lf0", 2, "v_lf0", [0.03], [0.001], None), ("gv-mgc", 2, "v_plain", [1.5, 0.1], [0.25, 0.01], None), ("gv-mgc", 2, "v_stressed", [2.5, 0.2], [0.5, 0.02], None), ("gv-bap", 2, "v_bap", [1.0], [0.125], None),
]


@query(f"""
    WITH {LABELS_SQL}, qs AS (SELECT *, regexp_matches(label, '(?s).-[aeiou]\\+.') AS vowel, contains(label, '/STRESS:1') AS stressed, contains(label, '-pau+') OR contains(label, '-sp+') AS pause FROM lb),
    lv AS (SELECT *, CASE WHEN vowel THEN [3.5::DOUBLE, 6.4, 2.0] WHEN pause THEN [8.0, 0.2, 8.0] ELSE [2.2, 4.5, 1.0] END AS dur,
      CASE state WHEN 2 THEN CASE WHEN vowel THEN [4.8::DOUBLE, 0.25, -0.5, 0.1, 0.9] ELSE [4.6, 0.125, 0.5, 0.1, 0.2] END ELSE CASE WHEN stressed THEN [5.0, 0.5, 0.25, 0.2, 0.95] ELSE [4.7, 0.0, 0.0, 0.3, 0.5] END END AS lf0,
      CASE WHEN vowel THEN [1.5::DOUBLE, 0.5, 0.25, 0.75, 0.1] WHEN pause THEN [-4.0, 0.0, 0.0, 0.0, 0.3] ELSE [0.5, -0.25, 0.5, 0.125, 0.2] END AS mgc FROM qs, (VALUES (2), (3), (4)) s(state))
    SELECT doc_id, sent_id, phone_no, CAST(state AS INT) AS state, CAST(greatest(floor(dur[state - 1] + 0.5), 1) AS INT) AS frames, lf0[5] >= 0.5 AS voiced, NOT pause AS spread, CASE WHEN lf0[5] < 0.5 THEN 0.0::DOUBLE ELSE lf0[1] END AS pitch, lf0[2] AS pitch_step, lf0[3] AS pitch_curve, lf0[4] AS pitch_var,
      mgc[1] AS level, mgc[4] AS tilt_step, mgc[5] AS level_var, CASE WHEN pause THEN 0.0::DOUBLE ELSE -3.0 END AS noise, CASE WHEN pause THEN 0.0::DOUBLE ELSE 0.5 END AS noise_step, 0.03::DOUBLE AS gv_pitch, CASE WHEN stressed THEN 2.5::DOUBLE ELSE 1.5 END AS gv_level, CASE WHEN stressed THEN 0.02::DOUBLE ELSE 0.01 END AS gv_tilt_var, 0.125::DOUBLE AS gv_noise_var FROM lv
""")
def stream_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Every label's and state's parameters of all seven streams, with differences and total variances, by one look-up."""
    questions = TREES.split("{*}")[0]
    trees = {name: a.parse_trees(questions + text) for name, text in STREAM_TREES.items()}
    switch = trees.pop("switch")
    densities = spark.createDataFrame(STREAM_DENSITIES, "stream string, state int, leaf string, mean array<double>, var array<double>, weight double")
    found = state_parameters(context_labels(spark, sf), ["doc_id", "sent_id", "phone_no"], trees, densities, 3, voicing=0.5, switch=switch)
    part = lambda stream, i, name, kind="mean": F.get(f"{stream}_{kind}", i).alias(name)
    return found.select(
        "doc_id", "sent_id", "phone_no", "state", "frames", "voiced", "spread", part("lf0", 0, "pitch"), part("lf0", 1, "pitch_step"), part("lf0", 2, "pitch_curve"), part("lf0", 0, "pitch_var", "var"), part("mgc", 0, "level"), part("mgc", 3, "tilt_step"), part("mgc", 0, "level_var", "var"),
        part("bap", 0, "noise"), part("bap", 1, "noise_step"), part("gv_lf0", 0, "gv_pitch"), part("gv_mgc", 0, "gv_level"), part("gv_mgc", 1, "gv_tilt_var", "var"), part("gv_bap", 0, "gv_noise_var", "var"),
    )


@query("""
    WITH t AS (SELECT conv_id, turn, length(text) AS frames FROM conversations)
    SELECT conv_id, turn, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, least(frames, 200, frames // 2 + 50) AS shortest FROM t
""")
def turn_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offset of each turn's characters in its conversation, and the shortest of three stream lengths."""
    from weftline.operators.context import offset_before
    from weftline.operators.counts import shortest

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("frames"))
    return rows.select("conv_id", "turn", "frames", offset_before("frames", ["conv_id"], ["turn"]).cast("long").alias("start"), shortest(F.col("frames"), F.lit(200), F.floor(F.col("frames") / 2) + 50).cast("long").alias("shortest"))


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER w, '#') AS prev_role, count(*) OVER w AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role", 1, "#").over(w).alias("prev_role"), F.count(F.lit(1)).over(w).alias("upto"))


@query()
def spoken_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of nations, from text through labels, states and trajectories to a wave file each."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.initcap("n_name").alias("text"))
    return speak(names).select("doc_id", "samples", F.length("wave").cast("long").alias("bytes"))
