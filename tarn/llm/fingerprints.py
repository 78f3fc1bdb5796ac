"""Fingerprints of texts by consistent weighted sampling, in DataFrame expressions only.

A text is a bag of terms: its runs of non-blanks, in pieces of 40 characters at
most, and each character of scripts that are written without blanks; a term's
weight is its number of occurrences. Sample j of a bag is the term that Ioffe's
scheme ("Improved Consistent Sampling, Weighted Minhash and L1 Sketching", 2010)
chooses: with r, c from Gamma(2, 1) and b uniform, all drawn from a hash of (term,
j), t = floor(ln w / r + b), and the term of least a = c exp(-r (t - b + 1)) with
its t is the sample. Two bags get the same sample with the probability of their
generalised Jaccard similarity, sum min(w, w') / sum max(w, w').

Draws: r is -ln(v q'), the sum of two exponentials, and b is the share of the second,
which is uniform and independent of r. Then a is c v (v q')**t, and t the largest m
with w v (v q')**(m-1) >= 1 (0, if none): no logarithm but that of c, a weight of 1
needs no power, and equal (term, t) give bit-equal a, so the least a alone is the
sample. 16 bits of its hash go into the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch

#: Samples of a fingerprint: groups, each a row of its own while samples are taken, of so many.
GROUPS, EACH = 12, 4
SAMPLES = GROUPS * EACH
#: Scripts without blanks between words, a character of which is a term, and the pieces that other runs are cut into.
DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TERM = rf"[{DENSE}]|[^\x20\x09-\x0D{DENSE}]{{1,40}}"
#: Powers that are told by comparing; the rest by logarithms.
NEAR = 3

KEY = ["void", "id", "h"]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _uniform(x: Column, shift: int) -> Column:
    """32 bits of a hash as a number between 0 and 1."""
    return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) * F.lit(2.0**-32)


def _sampled(weight: Column, v: Column, q: Column, e: Column) -> Column:
    """a of a term of this weight; null where the weight is 0. ``e``: c v, ``q``: v q'."""
    left = weight * v
    far = e * F.pow(q, F.floor(F.log(left) / -F.log(q)) + 1)
    out = F.when(left < 1, F.when(weight > 0, e))
    power, reach = q, left * q
    for _ in range(NEAR):
        out = out.when(reach < 1, e * power)
        power, reach = power * q, reach * q
    return out.otherwise(far)


def samples(counts: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """The keys and, for each column of weights, the fingerprint of the bag that it and ``term`` (a hash) make: ``print_<weight>``.

    Each row becomes GROUPS rows of EACH samples, so that the generated code stays
    small enough to be compiled; a partial minimum leaves a row a bag and group.
    """
    k = range(EACH)
    rows = counts.select(*keys, "term", *weights, F.explode(F.array(*map(F.lit, range(GROUPS)))).alias("g"))
    seed = F.col("g") * (2 * EACH)
    rows = rows.select(*keys, "g", *weights, *(F.xxhash64("term", seed + i).alias(f"x{i}") for i in range(2 * EACH)))
    drawn = [x for i in k for x in (
        _uniform(F.col(f"x{2 * i}"), 32).alias(f"v{i}"), (_uniform(F.col(f"x{2 * i}"), 32) * _uniform(F.col(f"x{2 * i}"), 0)).alias(f"q{i}"),
        (_uniform(F.col(f"x{2 * i}"), 32) * -F.log(_uniform(F.col(f"x{2 * i + 1}"), 32) * _uniform(F.col(f"x{2 * i + 1}"), 0))).alias(f"e{i}"),
    )]
    rows = rows.select(*keys, "g", *weights, *drawn)
    least = [F.min(_sampled(F.col(w), F.col(f"v{i}"), F.col(f"q{i}"), F.col(f"e{i}"))).alias(f"{w}_{i}") for w in weights for i in k]
    rows = rows.groupBy(*keys, "g").agg(*least)

    def piece(w: str) -> Column:
        packed = F.lit(0)
        for i in k:
            packed = F.shiftleft(packed.cast("long"), 16).bitwiseOR(F.xxhash64(f"{w}_{i}").bitwiseAND(F.lit(0xFFFF)))
        return F.lower(F.lpad(F.hex(packed), 16, "0")).alias(w)

    pieces = rows.select(*keys, F.struct("g", *map(piece, weights)).alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return pieces.select(*keys, *(F.array_join(F.col("p")[w], "").alias(f"print_{w}") for w in weights))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    same = lambda n, i: n + (F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0), same) / F.lit(float(SAMPLES))


def _follow(own: DataFrame, scratch: Scratch) -> DataFrame:
    """Each distinct row's key, characters n, copies m, and the key of the next one in the order of doc_id (after the last: the first); a written table.

    Only keys are sorted. A row's place is its range partition and its number in it,
    and what follows the last place of a partition is the first of the next: one
    number a partition reaches the driver.
    """
    spark = own.sparkSession
    keys = scratch.table(own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"), F.first(F.char_length("text").cast("long")).alias("n")), "keys")
    order = [F.desc("void"), F.asc("id"), F.asc("h")]
    keys = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    keys = scratch.table(keys.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sorted")
    last = sorted((r["part"], r["last"]) for r in keys.groupBy("part").agg(F.max("at").alias("last")).collect())
    ends = [(p, n, last[(k + 1) % len(last)][0]) for k, (p, n) in enumerate(last)]
    ends = spark.createDataFrame(ends, "part int, last long, after int")
    placed = keys.join(F.broadcast(ends), "part")  # a row a range partition
    inside = F.col("at") < F.col("last")
    asks = placed.select(*KEY, "m", "n", F.when(inside, F.col("part")).otherwise(F.col("after")).alias("part"), F.when(inside, F.col("at") + 1).otherwise(F.lit(0).cast("long")).alias("at"))
    there = keys.select("part", "at", *(F.col(c).alias(f"next_{c}") for c in KEY))
    out = scratch.table(asks.join(there, ["part", "at"]).drop("part", "at"), "next")
    scratch.drop("keys", "sorted")
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document's text. Rows are in the order of doc_id,
    those without one first, rows of one doc_id in the order of their text's hash;
    equal rows follow each other. Null counts as empty; texts without a term have
    one and the same fingerprint, which is like none other. With one row the next
    document is the row itself. A text of any length is one row of one task, its
    terms rows that are counted before they are sampled. No rows give no rows; other
    columns are not read.

    Texts are shuffled once and a quarter: to their key, and what each lends to the
    document before it. Terms and samples are then aggregated where they are, by keys
    that begin with the partitioning's. Copies of a row are one row until the end.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    text = F.coalesce(F.col("`text`"), F.lit(""))
    own = docs.select(F.col("`doc_id`").isNull().alias("void"), F.coalesce(F.col("`doc_id`").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    following = _follow(own, scratch)

    texts = own.groupBy(*KEY).agg(F.max("text").alias("text"))
    lent = F.substring("text", F.lit(1), F.floor(F.col("n") / 4).cast("int"))
    asked = following.select(F.struct(*KEY).alias("asks"), "m", "n", *(F.col(f"next_{c}").alias(c) for c in KEY))
    heads = texts.join(asked, KEY).select("asks.*", "m", "n", lent.alias("head"))
    both = texts.join(heads, KEY)
    one = F.struct(F.lit(0).alias("copy"), F.lit(1).cast("long").alias("rows"), F.col("head").alias("head"))
    more = F.struct(F.lit(1).alias("copy"), (F.col("m") - 1).alias("rows"), lent.alias("head"))  # all but the last of equal rows are followed by themselves
    both = both.select(*KEY, "text", "n", F.explode(F.when(F.col("m") > 1, F.array(one, more)).otherwise(F.array(one))).alias("x")).select(*KEY, "text", "n", "x.*")
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    both = both.select(*KEY, "copy", "rows", "n", "text", "head", kept.alias("kept"))

    # what both texts share up to the last blank before the cut is cut into terms once
    cut = both.select(*KEY, "copy", "text", "head", "kept", F.regexp_extract("kept", r"(?s)^.*[\x20\x09-\x0D]", 0).alias("safe"))
    after = lambda c: F.substring(c, F.char_length("safe") + 1, F.lit(0x7FFFFFFF))
    cut = cut.select(*KEY, "copy", terms(F.col("safe")).alias("t0"), terms(after("text")).alias("t1"), terms(F.concat(after("kept"), "head")).alias("t2"))
    cut = cut.select(*KEY, "copy", F.size("t0").alias("a"), (F.size("t0") + F.size("t1")).alias("b"), F.posexplode_outer(F.concat("t0", "t1", "t2")).alias("at", "term"))
    first, second = F.col("at") < F.col("b"), (F.col("at") < F.col("a")) | (F.col("at") >= F.col("b"))
    counts = cut.select(*KEY, "copy", F.xxhash64("term").alias("term"), F.when(first, 1).otherwise(0).alias("first"), F.when(second, 1).otherwise(0).alias("second"))
    counts = counts.groupBy(*KEY, "copy", "term").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
    prints = samples(counts, [*KEY, "copy"], ["first", "second"])

    digests = both.select(*KEY, "copy", "rows", "n", F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"))
    found = scratch.table(digests.join(prints, [*KEY, "copy"]), "prints")
    ahead = found.where("copy = 0").select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("print_first").alias("ahead"))
    ahead = following.select(*KEY, *(f"next_{c}" for c in KEY)).join(ahead, [f"next_{c}" for c in KEY]).select(*KEY, F.lit(0).alias("copy"), "ahead")
    rows = found.join(ahead, [*KEY, "copy"], "left")
    out = rows.select(
        F.when(~F.col("void"), F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", F.col("print_first").alias("fingerprint"), F.col("print_second").alias("edited_fingerprint"),
        likeness(F.col("print_first"), F.col("print_second")).alias("near_edited"), F.when(F.col("copy") == 1, 1.0).otherwise(likeness(F.col("print_first"), F.col("ahead"))).alias("near_next"), "rows",
    )
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")
