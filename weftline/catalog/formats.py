"""Files written and read back: lines, marked encodings, listings, audio, labels, units, frames, tables, models, images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog.models import TREE_SQL, counted_bags, features, grown_sql
from weftline.catalog.numeric import user_arrays
from weftline.catalog.registry import query, scratch, table
from weftline.functions.predicates import lexicon_entry_usable
from weftline.functions.text import training_line
from weftline.operators import tree as tr
from weftline.sources import audio, sinks
from weftline.sources import text as src


def stem_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


@query("SELECT c_name || ' ' || c_mktsegment AS value FROM customer WHERE c_acctbal >= 0")
def line_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in credit as lines, the others appended as comments; read without the comments."""
    folder = scratch(spark, "lines")
    rows = table(spark, sf, "customer").select("c_acctbal", F.concat_ws(" ", "c_name", "c_mktsegment").alias("shown"))
    sinks.write_lines(rows.filter("c_acctbal >= 0"), F.col("shown"), folder)
    sinks.write_lines(rows.filter("c_acctbal < 0"), F.concat(F.lit("# "), "shown"), folder, "append")
    return src.read_lines(spark, folder, comments=True)


@query("SELECT n_nationkey, encoding, n_name AS text FROM nation, (VALUES ('UTF-8'), ('UTF-16LE'), ('UTF-16BE'), ('UTF-32BE'), (NULL)) e(encoding)")
def marked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Names in several encodings with their byte order marks, and in UTF-8 without one, told apart and decoded."""
    kinds = [("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"), ("0000FEFF", "UTF-32"), ("", "UTF-8")]
    contents = F.array(*(F.concat(F.unhex(F.lit(mark)), F.encode("n_name", charset)) for mark, charset in kinds))
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(contents).alias("content"))
    return rows.select("n_nationkey", src.encoding_of(F.col("content")).alias("encoding"), src.decoded(F.col("content")).alias("text"))


def _written(spark: SparkSession, sf: str) -> str:
    """A folder with a .lab file for every nation, a .wav for those of regions from 1 on and an .f0 for those from 2 on."""
    folder = scratch(spark, "files")
    rows = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("stem"), "n_regionkey", F.encode("n_name", "UTF-8").alias("content"))
    for least, extension in enumerate(("lab", "wav", "f0")):
        audio.write_binary(rows.filter(F.col("n_regionkey") >= least).withColumn("name", F.concat_ws(".", "stem", F.lit(extension))), "name", "content", folder)
    return folder


@query("SELECT 'n' || n_nationkey AS stem, n_name AS text, n_regionkey >= 2 AS complete FROM nation")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files by extension with their contents, and whether both siblings of a file are there."""
    folder = _written(spark, sf)
    whole = src.complete_files(spark, folder, "lab", ("wav", "f0")).withColumn("complete", F.lit(True))
    return src.read_files(spark, folder, "lab").join(whole, "stem", "left").select("stem", F.decode("content", "UTF-8").alias("text"), F.coalesce("complete", F.lit(False)).alias("complete"))


@query("SELECT extension, count(*) AS n FROM nation, (VALUES ('lab', 0), ('wav', 1), ('f0', 2)) e(extension, least) WHERE n_regionkey >= least GROUP BY extension")
def file_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return src.file_counts(spark, _written(spark, sf), ("lab", "wav", "f0"))


#: CTE ws: each user's samples as 16-bit numbers, from values of which 500 stands for full scale.
WAVE_SQL = "ws AS (SELECT user_id, list(CAST(trunc(least(value / 500.0, 1.0) * 32767) AS INT) ORDER BY event_id) AS s FROM events GROUP BY user_id)"


def user_waves(spark: SparkSession, sf: str) -> DataFrame:
    """user_id and the columns of read_waves: each user's values as a wave file, written and read back."""
    folder = scratch(spark, "waves")
    scaled = F.transform("x", lambda v: F.least(v / 500.0, F.lit(1.0)))
    files = user_arrays(spark, sf).select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".wav")).alias("name"), audio.wave_bytes(scaled, 8000).alias("content"))
    audio.write_binary(files, "name", "content", folder)
    return audio.read_waves(spark, folder).withColumn("user_id", F.substring(stem_of(), 2, 20).cast("long"))


@query(f"WITH {WAVE_SQL} SELECT user_id, 8000 AS sample_rate, 1 AS channels, 16 AS valid_bits, len(s) AS n_frames, CAST(list_sum(s) AS BIGINT) AS total, list_max(s) AS most, CAST(NULL AS VARCHAR) AS error FROM ws")
def wave_files(spark: SparkSession, sf: str) -> DataFrame:
    """Header and samples of every wave file."""
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x)
    return user_waves(spark, sf).select("user_id", "sample_rate", "channels", "valid_bits", "n_frames", total.alias("total"), F.array_max("samples").alias("most"), "error")


@query(f"WITH {WAVE_SQL} SELECT user_id, CAST((len(s) + 1) // 2 AS BIGINT) AS evens, CAST(coalesce(list_sum(s[2:4]), 0) AS BIGINT) AS inner_sum, round(list_sum(list_transform(s, lambda x: x / 32768.0)), 9) AS level FROM ws WHERE len(s) <= 8000 * 10")
def wave_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples read as two interleaved channels, as a slice and as fractions, of files of ten seconds at most."""
    waves = user_waves(spark, sf).filter(audio.within_seconds(F.col("samples"), F.col("sample_rate"), 10.0))
    add = lambda values, start: F.aggregate(values, start, lambda s, x: s + x)
    inner = add(F.transform(audio.frames_between(F.col("samples"), F.col("channels"), 1, 3), lambda x: x.cast("long")), F.lit(0).cast("long"))
    return waves.select("user_id", F.size(audio.channel(F.col("samples"), F.lit(2), 0)).cast("long").alias("evens"), inner.alias("inner_sum"), F.round(add(audio.as_floats(F.col("samples"), F.col("valid_bits")), F.lit(0.0)), 9).alias("level"))


@query(f"WITH {WAVE_SQL} SELECT user_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS sample FROM ws")
def wave_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sample."""
    rows = audio.sample_rows(user_waves(spark, sf))
    return rows.select(F.substring(stem_of(), 2, 20).cast("long").alias("user_id"), F.col("i").cast("long").alias("i"), "sample")


@query(f"""
    WITH {WAVE_SQL}, y AS (SELECT user_id, list_transform(s, lambda x: sign(x) * ln(1 + 255 * abs(x / 32768.0)) / ln(256)) AS y FROM ws)
    SELECT user_id, CAST(list_sum(list_transform(y, lambda v: CAST(trunc((v + 1) * 127) AS BIGINT))) AS BIGINT) AS codes, round(list_sum(y), 6) AS companded FROM y
""")
def wave_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the discrete and the continuous companded values of every file."""
    codes, companded = audio.code_pair(audio.as_floats(F.col("samples"), F.col("valid_bits")))
    add = lambda values, start: F.aggregate(values, start, lambda s, x: s + x)
    return user_waves(spark, sf).select("user_id", add(F.transform(codes, lambda c: c.cast("long")), F.lit(0).cast("long")).alias("codes"), F.round(add(companded, F.lit(0.0)), 6).alias("companded"))


@query("SELECT user_id, 4 * count(*) AS bytes FROM events GROUP BY user_id")
def float_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Raw 32-bit floats of each user's values, in a file each: their sizes."""
    folder = scratch(spark, "floats")
    files = user_arrays(spark, sf).select(F.concat(F.col("user_id").cast("string"), F.lit(".raw")).alias("name"), audio.float_bytes(F.col("x")).alias("content"))
    audio.write_binary(files, "name", "content", folder)
    return src.read_files(spark, folder, "raw").select(F.col("stem").cast("long").alias("user_id"), F.length("content").cast("long").alias("bytes"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS leaf, CAST(n_nationkey AS DOUBLE) AS mean, n_nationkey + 0.5::DOUBLE AS var, 0.25::DOUBLE AS weight FROM nation")
def density_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Means, variances and weights of leaves out of big-endian files, one for each region with a leaf for each nation."""
    values = F.flatten(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.array(k.cast("double"), k + 0.5, F.lit(0.25))))
    files = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(values.alias("v"), F.count(F.lit(1)).cast("int").alias("leaves")).select("region", "leaves", audio.float_bytes(F.col("v"), little=False).alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(region, leaf, mean[0], var[0], weight) for region, leaves, content in zip(batch["region"], batch["leaves"], batch["content"], strict=True) for _, leaf, mean, var, weight in audio.parse_densities(bytes(content), [int(leaves)], 1, True)]
            yield pd.DataFrame(rows, columns=["region", "leaf", "mean", "var", "weight"])

    return files.mapInPandas(parse, "region long, leaf long, mean double, var double, weight double")


@query("SELECT p_partkey, 2 AS numbers, CAST(p_size AS DOUBLE) AS first, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS second FROM part")
def matrix_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of lines with repeated blanks."""
    lines = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit("   "), F.col("p_retailprice").cast("string"), F.lit(" ")).alias("value"))
    found = lines.select("p_partkey", src.floats_of(F.col("value")).alias("x"))
    return found.select("p_partkey", F.size("x").alias("numbers"), F.get("x", 0).cast("double").alias("first"), F.get("x", 1).cast("double").alias("second"))


@query("SELECT CAST(event_id * 70000 // 50000 AS INT) AS start, CAST((event_id * 70000 + 1500000) // 50000 AS INT) AS stop, event_type AS phone FROM events")
def monophone_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of `start stop phone` lines."""
    start = F.col("event_id") * 70_000
    return src.read_monophones(table(spark, sf, "events").select(F.concat_ws(" ", start.cast("string"), (start + 1_500_000).cast("string"), "event_type").alias("value")))


@query("SELECT CAST(event_id * 12345 // 10000 AS INT) AS start_ms, CAST((event_id * 12345 + 1500000) // 10000 AS INT) AS stop_ms, CAST((event_id * 12345 + 1500000) // 10000 - event_id * 12345 // 10000 AS INT) AS duration_ms, event_type AS phone, user_id || '|B:' || event_id AS context FROM events")
def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Times, phone and context fields of full-context label lines."""
    start = F.col("event_id") * 12_345
    label = F.concat(F.lit("a^b-"), "event_type", F.lit("+c=d/A:"), F.col("user_id").cast("string"), F.lit("/B:"), F.col("event_id").cast("string"))
    lines = table(spark, sf, "events").select(F.concat_ws(" ", start.cast("string"), (start + 1_500_000).cast("string"), label).alias("value"))
    return src.read_full_labels(lines).withColumn("context", F.array_join("context", "|"))


@query("""
    WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, CASE WHEN l_linestatus = 'F' THEN '#' ELSE '' END || l_returnflag AS phone, l_linenumber * 10 + 7 AS start, l_linenumber * 10 + 17 AS stop FROM lineitem),
    f AS (SELECT *, start - min(start) OVER (PARTITION BY file) AS file_start FROM l) SELECT file, phone, start, stop, file_start FROM f WHERE NOT starts_with(phone, '#')
""")
def unit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Units of an index, with starts from their file's first unit; those whose phone starts with # are none."""
    start = F.col("l_linenumber") * 10 + 7
    phone = F.concat(F.when(F.col("l_linestatus") == "F", "#").otherwise(""), F.col("l_returnflag"))
    return src.read_units(table(spark, sf, "lineitem").select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), phone, start.cast("string"), (start + 10).cast("string")).alias("value")))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS frame, l_quantity AS sp FROM lineitem WHERE l_orderkey = 7 AND l_linenumber BETWEEN 2 AND 5")
def stored_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames 2 to 5 of file 7 of a store of frames: random access is what it is for."""
    folder = scratch(spark, "frames")
    sinks.write_frames(table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("sp")), folder)
    return src.frame_slice(spark.read.parquet(folder), "7", 2, 5)


@query('SELECT l_orderkey AS file, count(*) AS frames, CAST(coalesce(sum(count(*)) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem GROUP BY l_orderkey')
def frame_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of all files before each file."""
    return sinks.frame_offsets(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count(F.lit(1)).alias("frames")))


@query("SELECT o_orderstatus AS word, replace(o_orderpriority, ' ', '_') AS tag, CAST(count(*) AS INT) AS n FROM orders GROUP BY ALL")
def word_tag_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of tags out of `word tag n tag n ...` lines."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("word"), F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "tag", F.col("n").cast("string")))), " ")
    return src.read_word_tags(counts.groupBy("word").agg(pairs.alias("pairs")).select(F.concat_ws(" ", "word", "pairs").alias("value")))


@query("SELECT replace(o_orderpriority, ' ', '_') AS tag, CAST(count(*) AS INT) AS n FROM orders GROUP BY ALL")
def tag_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Counts out of `tag n` lines, through a file."""
    folder = scratch(spark, "tags")
    counts = table(spark, sf, "orders").groupBy(F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_lines(counts, F.concat_ws(" ", "tag", F.col("n").cast("string")), folder)
    return src.read_tag_counts(src.read_lines(spark, folder))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS tag FROM lineitem), b AS (SELECT coalesce(lag(tag) OVER w, '_') AS prev, tag AS next FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, tag)),
    c AS (SELECT prev, next, count(*) AS n FROM b GROUP BY prev, next) SELECT prev, next, round(n / sum(n) OVER (PARTITION BY prev), 1) AS p FROM c
""")
def transition_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of transition_file read back."""
    from weftline.catalog.joins import transition_file

    return src.read_transitions(transition_file(spark, sf))


@query("""
    WITH w AS (SELECT replace(n_name, ' ', '_') AS word, n_regionkey AS r FROM nation)
    SELECT word, CASE WHEN r = 0 THEN word ELSE lower(word) END AS lemma, CASE WHEN r < 3 THEN 'tag' || r ELSE 'R' || r END AS msd FROM w WHERE r NOT IN (0, 1) OR NOT contains(word, '_')
""")
def lexicon_rows(spark: SparkSession, sf: str) -> DataFrame:
    """`word lemma msd` lines with = for the word itself, descriptions renamed where a table knows them; of two regions' words those that can be learnt from."""
    r = F.col("n_regionkey")
    words = table(spark, sf, "nation").select("n_regionkey", F.replace("n_name", F.lit(" "), F.lit("_")).alias("word")).filter(~r.isin(0, 1) | lexicon_entry_usable(F.col("word"), F.lit(1)))
    lines = words.select(F.concat_ws("  ", "word", F.when(r == 0, "=").otherwise(F.lower("word")), F.concat(F.lit("R"), r.cast("string"))).alias("value"))
    return src.read_lexicon(lines, spark.createDataFrame([(f"R{i}", f"tag{i}") for i in range(3)], "msd string, tag string"))


@query("SELECT section, line FROM (VALUES ('NONTERM', 'Np'), ('NONTERM', 'Vp'), ('STARTSYM', 'Np'), ('RULES', 'Np -> ''<W>'' Vp?'), ('RULES', 'Vp -> ''<S>''')) v(section, line)")
def grammar_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a grammar file by section, comments left out."""
    found = src.read_sections("NONTERM:\nNp\nVp\nSTARTSYM:\n# the first\nNp\nRULES:\nNp -> '<W>' Vp?\n\nVp -> '<S>'\n")
    return spark.createDataFrame([(name, line) for name, lines in found.items() for line in lines], "section string, line string")


@query("SELECT doc_id, 'cl:' || lang || ' cl:' || CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END || ' ' || coalesce(source, 'none') AS line FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def training_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Features with the prefix cl:, then the label."""
    docs = table(spark, sf, "documents").filter("lang IS NOT NULL AND text IS NOT NULL")
    feats = F.array(F.concat(F.lit("cl:"), "lang"), F.concat(F.lit("n:"), F.char_length("text").cast("string")), F.when(F.char_length("text") < 300, "cl:short").otherwise("cl:long"))
    return docs.select("doc_id", training_line(feats, F.coalesce("source", F.lit("none"))).alias("line"))


def quality_tree(spark: SparkSession, sf: str) -> tr.Node:
    return tr.grow(counted_bags(spark, sf), cut_off=8, max_depth=6)


@query(f"WITH {TREE_SQL}, {grown_sql('lb', 'ab', 'doc_id', 6, 8)} SELECT doc_id, predicted FROM pr")
def reread_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document by the tree of tree_predictions, written to a file, read, reduced and parsed again."""
    folder = scratch(spark, "tree")
    whole = spark.createDataFrame([("t.tree", tr.dump(quality_tree(spark, sf)).encode())], "name string, content binary")
    audio.write_binary(whole, "name", "content", folder)
    text = bytes(src.read_files(spark, folder, "tree").first()["content"]).decode()
    return tr.classify(table(spark, sf, "documents").select("doc_id", features(F.col("text")).alias("feats")), tr.parse(tr.shrink(text)), "feats", largest_case=0).select("doc_id", "predicted")


@query(f"""
    WITH {TREE_SQL}, {grown_sql('lb', 'ab', 'doc_id', 6, 8)}, n AS (SELECT node, count(DISTINCT label) = 1 AS pure FROM b6 GROUP BY node)
    SELECT count(*) FILTER (pure) AS green, count(*) FILTER (NOT pure) AS yellow, 2 * (count(*) - 1) AS edges FROM n
""")
def tree_drawing(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of one label, other leaves, and edges of the drawing of that tree."""
    drawn = spark.createDataFrame([(tr.graphviz(quality_tree(spark, sf)),)], "drawn string")
    count = lambda part: F.regexp_count("drawn", F.lit(part)).cast("long")
    return drawn.select(count("fillcolor=green").alias("green"), count("fillcolor=yellow").alias("yellow"), count("->").alias("edges"))


@query("SELECT user_id, count(*) AS frames, 'P6' || chr(10) || count(*) || ' 2' || chr(10) || '255' AS ppm_head, length('P6' || chr(10) || count(*) || ' 2' || chr(10) || '255' || chr(10)) + 6 * count(*) AS ppm_bytes, count(*) AS png_width, 2 AS png_height FROM events GROUP BY user_id")
def spectrum_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of each user's frames (a value and its half): the header and size of one format, the dimensions in the other."""
    frames = user_arrays(spark, sf).select("user_id", F.transform("x", lambda v: F.array(v, v / 2)).alias("frames"))
    ppm, png = (sinks.spectrum_images(frames, "user_id", "frames", kind).withColumnRenamed("image", kind) for kind in ("ppm", "png"))
    number = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10)
    head = F.decode(F.substring(F.col("ppm"), F.lit(1), F.length("ppm") - 6 * F.col("frames") - 1), "UTF-8")
    both = ppm.join(png, "user_id").join(frames.select("user_id", F.size("frames").cast("long").alias("frames")), "user_id")
    return both.select("user_id", "frames", head.alias("ppm_head"), F.length("ppm").cast("long").alias("ppm_bytes"), number(17).cast("long").alias("png_width"), number(21).cast("int").alias("png_height"))


@query("""
    WITH x AS (SELECT user_id, list(value ORDER BY event_id) AS x FROM events GROUP BY user_id), k AS (SELECT user_id, x, len(x) * 4000 // 8000 AS n FROM x)
    SELECT user_id, CAST(n AS BIGINT) AS n, round(coalesce(list_sum(list_transform(range(n), lambda i: x[2 * i + 1])), 0), 6) AS total FROM k
""")
def resampled_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's values at half the rate: how many, and their sum."""
    half = user_arrays(spark, sf).select("user_id", audio.resampled(F.col("x"), 8000, 4000).alias("y"))
    return half.select("user_id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))

