"""Counting operators: transitions, distributions, entropy, gain, evaluation, vocabularies, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = "_"


def bigrams(df: DataFrame, value: str, partition: list[str], order: str) -> DataFrame:
    """prev, next, n: counts of neighbours, the sequence's edges included as `_`."""
    w = Window.partitionBy(*partition).orderBy(order)
    prev = F.lag(value, 1, EDGE).over(w)
    last = F.lead(F.lit(1)).over(w).isNull()
    pairs = df.select(prev.alias("prev"), F.col(value).alias("next"), last.alias("last"))
    both = F.when(F.col("last"), F.array(F.struct("prev", "next"), F.struct(F.col("next").alias("prev"), F.lit(EDGE).alias("next")))).otherwise(F.array(F.struct("prev", "next")))
    return pairs.select(F.inline(both)).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


def bigrams_in(df: DataFrame, words: str) -> DataFrame:
    """The same of arrays that hold whole sequences: pairs are made in place and summed before anything is shuffled."""
    w, edge = F.col(words), F.array(F.lit(EDGE))
    edges = F.arrays_zip(F.concat(edge, w).alias("prev"), F.concat(w, edge).alias("next"))
    return df.filter(F.size(w) > 0).select(F.inline(edges)).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


def conditional(counts: DataFrame, given: list[str], n: str = "n", name: str = "p") -> DataFrame:
    """name: each count's share of the counts with the same given columns; the total is joined, so a frequent condition is summed before the shuffle."""
    totals = counts.groupBy(*given).agg(F.sum(n).alias("_total"))
    return counts.join(totals, given).withColumn(name, F.col(n) / F.col("_total")).drop("_total")


def unigrams(df: DataFrame, value: str, label: str) -> DataFrame:
    """value, label, n, p: how often a value has each label."""
    return conditional(df.groupBy(value, label).agg(F.count(F.lit(1)).alias("n")), [value])


def bag_counts(df: DataFrame, label: str, features: str) -> DataFrame:
    """label, feats, n: how often each label comes with the same bag of features."""
    return df.groupBy(label, F.array_sort(features).alias("feats")).agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """by, total, entropy (base 2) of counts with one row per class."""
    total = F.sum(n)
    sum_nlog = F.sum(F.when(F.col(n) > 0, F.col(n) * F.log2(F.col(n).cast("double"))).otherwise(0.0))
    return counts.groupBy(*by).agg(total.alias("total"), (F.log2(total.cast("double")) - sum_nlog / total).alias("entropy"))


def _h(*parts: Column) -> Column:
    """Entropy of class counts, as total * log2(total) - sum of n * log2(n)."""
    nlogn = lambda x: F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0)
    return sum((nlogn(x) for x in parts), F.lit(0.0))


def information_gain(bags: DataFrame, label: str = "label", features: str = "feats", n: str = "n", node: list[str] | None = None, least: float = 0) -> DataFrame:
    """node, feature, yes, no, gain: of every binary feature, within every node, what splitting on it gains.

    bags has a row per label and bag with its count. The side without a feature is the total less the side with it; the
    totals are counted in the same pass, as those of a feature that every bag has. Splits whose smaller side has fewer than
    `least` are left out.
    """
    node = node or []
    every = F.array(F.lit(None).cast("string"))
    counts = bags.select(*node, label, n, F.explode(F.concat(F.array_distinct(features), every)).alias("feature")).groupBy(*node, "feature", label).agg(F.sum(n).cast("double").alias("yes"))
    whole = F.max(F.when(F.col("feature").isNull(), F.col("yes"))).over(Window.partitionBy(*node, label))
    each = counts.withColumn("all", whole)
    sides = each.groupBy(*node, "feature").agg(F.sum("yes").alias("yes_n"), F.sum(_h(F.col("yes"))).alias("yes_nlogn"), F.sum(_h(F.col("all") - F.col("yes")) - _h(F.col("all"))).alias("less_nlogn"))
    totals = sides.filter("feature IS NULL").select(*node, F.col("yes_n").alias("node_n"), F.col("yes_nlogn").alias("node_nlogn"))
    found = sides.filter("feature IS NOT NULL")
    # Without nodes one row, else one for each node.
    found = found.join(totals, node) if node else found.crossJoin(F.broadcast(totals))
    no_n = F.col("node_n") - F.col("yes_n")
    h = lambda total, nlogn: _h(total) - nlogn
    gain = (h(F.col("node_n"), F.col("node_nlogn")) - h(F.col("yes_n"), F.col("yes_nlogn")) - h(no_n, F.col("node_nlogn") + F.col("less_nlogn"))) / F.col("node_n")
    return found.filter((no_n > 0) & (F.least(F.col("yes_n"), no_n) >= least)).select(*node, "feature", F.col("yes_n").alias("yes"), no_n.alias("no"), gain.alias("gain"))


def leaf_distribution(counts: DataFrame, by: list[str], label: str, n: str = "n") -> DataFrame:
    """by, dist: labels with their shares, the most frequent first, of equal ones the first by name."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("neg"), F.col(label).alias("label"))))
    total = F.sum(n)
    return counts.groupBy(*by).agg(ranked.alias("r"), total.alias("t")).select(*by, F.transform("r", lambda x: F.struct(x["label"].alias("label"), (-x["neg"] / F.col("t")).alias("p"))).alias("dist"))


def argmax(values: Column) -> Column:
    """Position (from 0) of the largest element, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def item_accuracy(df: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    return df.agg(F.avg((predicted == gold).cast("double")).alias("accuracy"))


def group_accuracy(df: DataFrame, group: list[str], predicted: Column, gold: Column) -> DataFrame:
    """Share of groups (words) all of whose items are right."""
    return df.groupBy(*group).agg(F.min((predicted == gold).cast("int")).alias("ok")).agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


def f_score(df: DataFrame, predicted: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of boolean columns; a score without a denominator is 0."""
    is_true = lambda c: F.col(c)
    both = F.sum((is_true(predicted) & is_true(gold)).cast("long")).alias("tp")
    found = df.groupBy(*(by or [])).agg(both, F.sum(is_true(predicted).cast("long")).alias("pp"), F.sum(is_true(gold).cast("long")).alias("gp"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return found.select(*(by or []), share("tp", "pp").alias("precision"), share("tp", "gp").alias("recall"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("pp") + F.col("gp"), F.lit(0)), F.lit(0.0)).alias("f1"))


def log_loss(df: DataFrame, p: Column) -> DataFrame:
    return df.agg((-F.sum(F.log(p))).alias("loss"))


def every_nth(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """part: `test` for every nth distinct key in order, else `train`.

    The rank is counted by ranges of the key that the data are sorted into, so no task ranks all keys.
    """
    keys = df.select(key).distinct()
    ranked = dense_order(keys, key).select(key, F.when(F.col("rank") % n == 0, "test").otherwise("train").alias("part"))
    return df.join(ranked, key)


def splitters(keys: DataFrame, key: str, n: int = 256, each: int = 32) -> list:
    """About n values that cut the keys into even ranges, from the n * each rows whose hash is least. Results never depend on them, only the sizes of tasks."""
    sample = keys.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(n * each)
    found = sorted(r[0] for r in sample.collect())
    return sorted({found[i * len(found) // n] for i in range(1, n)} if found else set())


def range_of(key: Column, splits: list) -> Column:
    """Number of splitters at or below the key: of coarse ones first, then of those between two of them."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    below = lambda values: F.size(F.filter(values, lambda x: x <= key))
    coarse = F.array(*(F.lit(g[0]) for g in groups))
    fine = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    at = below(coarse)
    return F.coalesce(F.when(at > 0, (at - 1) * step + below(F.get(fine, at - 1))).otherwise(0), F.lit(0))


def dense_order(keys: DataFrame, key: str, among: list[str] | None = None) -> DataFrame:
    """rank (from 0) of each distinct key in order (within `among`): counts by sampled ranges of the key, then ranks inside them."""
    among = among or []
    held = keys.withColumn("_range", range_of(F.col(key), splitters(keys, key)))
    sizes = held.groupBy(*among, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(*among).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = held.withColumn("_inside", F.row_number().over(Window.partitionBy(*among, "_range").orderBy(key)) - 1)
    return ranked.join(starts.drop("_n"), [*among, "_range"]).withColumn("rank", (F.col("_start") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_start")


def offsets_before(df: DataFrame, value: str, by: list[str], order: str, out: str = "offset") -> DataFrame:
    """out: sum of the values of all earlier rows with the same `by`, whose rows may be any share of all: sums by sampled
    ranges of the order, then running sums inside them."""
    held = df.withColumn("_range", range_of(F.col(order), splitters(df, order)))
    sums = held.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_inside", inside).join(starts.drop("_sum"), [*by, "_range"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def vocabulary(df: DataFrame, value: str, order: list[str], reserve: str | None = "#", bounds: tuple[int, int] | None = None) -> DataFrame:
    """value, id: dense ids in the order of first appearance; with `reserve`, id 0 is kept for that value.

    Firsts are aggregated map-side; only the distinct values are ranked, within at most 4096 ranges of the first order
    column (an integer), whose sizes give the ranges' offsets. bounds are that column's least and greatest value, if the
    caller knows them more cheaply than from df.
    """
    firsts = df.filter(F.col(value).isNotNull() & (F.col(value) != F.lit(reserve)) if reserve is not None else F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    first_col = F.col(f"first.{order[0]}")
    low, high = bounds or firsts.agg(F.min(first_col), F.max(first_col)).first()
    spread = F.floor((first_col - F.lit(low)) / F.lit(((high - low) // 4096 + 1) if low is not None else 1))
    held = firsts.withColumn("_run", spread)
    sizes = held.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows, one for each range.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy("first")) - 1
    ids = held.withColumn("_inside", inside).join(starts, "_run").select(value, (F.col("_start") + F.col("_inside") + F.lit(0 if reserve is None else 1)).cast("long").alias("id"))
    return ids if reserve is None else ids.unionByName(df.sparkSession.createDataFrame([(reserve, 0)], f"{value} string, id long"))


def suffix_histogram(df: DataFrame, length: str) -> DataFrame:
    return df.groupBy(length).agg(F.count(F.lit(1)).alias("n"))


def sentence_totals(df: DataFrame, by: list[str], syllables: Column, stressed: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("words"), F.sum(syllables).alias("syllables"), F.sum(stressed).alias("stressed"))


def sentence_type(df: DataFrame, by: list[str], word: str, order: str) -> DataFrame:
    """question or exclamation by the leftmost ? or !, else statement."""
    kind = F.when(F.col(word) == "?", "question").when(F.col(word) == "!", "exclamation")
    return df.groupBy(*by).agg(F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), F.col(order))), F.lit("statement")).alias("sentence_type"))


def z_normalise(df: DataFrame, key: list[str], values: str) -> DataFrame:
    """key, dim, value, z: array elements less their dimension's mean, over its population deviation (1 where that is 0)."""
    each = df.select(*key, F.posexplode(values).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    stats = each.groupBy("dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return each.join(stats, "dim").select(*key, "dim", "value", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))


def moments(df: DataFrame, value: Column, by: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    """n, least, most, mean, sample deviation, population variance; of the rows of the mask alone, if one is given."""
    value = value if mask is None else F.when(mask, value)
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_pop(value).alias("var"))


def voiced_mean(f0: Column, factor: float = 0.7) -> Column:
    """Aggregate: mean of the non-zero pitches times a factor, 0 where none is voiced."""
    return F.coalesce(F.avg(F.when(f0 > 0, f0)), F.lit(0.0)) * factor


def frame_counts(duration: Column, voiced: Column) -> tuple[Column, Column]:
    """Aggregates: all frames, and those of voiced states."""
    return F.sum(duration).alias("frames"), F.coalesce(F.sum(F.when(voiced, duration)), F.lit(0)).alias("voiced_frames")


def shortest(*streams: Column) -> Column:
    return F.least(*streams)


def corpus_sizes(df: DataFrame, columns: list[str], states: Column) -> DataFrame:
    """Distinct values of each column and the total of states."""
    return df.agg(*(F.count_distinct(c).alias(f"{c}_size") for c in columns), F.sum(states).alias("states"))
