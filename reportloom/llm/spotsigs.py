"""Document fingerprints by SpotSigs, with DataFrame functions only.

A spot signature is a common-word anchor with the chain of the next ``CHAIN`` content words; words that are common but no
anchors, and anchors on the way, are passed over. A text's fingerprint is the set of its signatures, each as eight hex
digits of its MD5, sorted. A text without a signature has one for all its words, so only equal word sequences agree.
Likeness is the Jaccard of two sets; sets whose lengths alone keep it below the least wanted are not intersected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.cluster import cut, salted_join
from reportloom.llm.components import components

CHAIN = 2
#: Anchors and other common words of the languages at hand. Fixed values.
ANCHORS = "the is was that der die das ist le la est dans el los que una".split()
COMMON = "a an and are as at be by for from had has he her his i in it its not of on or she this to were which with you den dem des ein eine er es für im in mit nicht sich sie und von zu au aux ce de des du elle en et il les ne pas pour qui se sur un une con del en las lo no para por se su un y".split()
#: The order of doc_ids is cut into parts of about so many bytes of text, and no more parts than the second figure.
PART_BYTES, MOST_PARTS = 64 << 20, 10_000


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def fingerprint(text: Column) -> Column:
    """Eight hex digits of each signature of the text, sorted and joined.

    The text is cut at its content words, so what lies before each of them is a run of anchors: every distinct anchor of
    the run begins a chain there. Time is linear in the text, however long the runs are.
    """
    anchor, skipped = _any(ANCHORS), _any([w for w in COMMON if w not in ANCHORS])
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    spare = F.regexp_replace(plain, f" {skipped}(?= )", "")
    runs = F.split(spare, f" (?!{anchor} )[^ ]++(?= )")
    content = F.split(F.trim(F.regexp_replace(spare, f" {anchor}(?= )", "")), " ")
    nothing = F.array().cast("array<string>")

    def chains(p: Column) -> Column:
        after = lambda a, k: F.concat_ws(" ", a, *[F.get(p["content"], k + i) for i in range(CHAIN)])
        here = lambda run, k: F.transform(F.array_distinct(F.split(F.trim(run), " ")), lambda a: after(a, k))
        return F.flatten(F.transform(p["runs"], lambda run, k: F.when((F.trim(run) != "") & (k + CHAIN <= F.size(p["content"])), here(run, k)).otherwise(nothing)))

    # the struct in an array binds the two lists once for all elements
    spots = F.transform(F.array(F.struct(runs.alias("runs"), content.alias("content"), plain.alias("plain"))), lambda p: F.struct(chains(p).alias("c"), p["plain"].alias("plain")))
    prints = F.transform(spots, lambda p: F.when(F.size(p["c"]) > 0, F.array_distinct(p["c"])).otherwise(F.array(p["plain"])))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.get(prints, F.lit(0)), lambda s: F.substring(F.md5(s), 1, 8)))), "")


def parts(print_: Column) -> Column:
    return F.regexp_extract_all(print_, F.lit("[0-9a-f]{8}"), F.lit(0))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two fingerprints; 0 without intersecting where the lengths keep it below ``least``."""
    shared = F.size(F.array_intersect(parts(a), parts(b)))
    n, m = F.length(a) / 8, F.length(b) / 8
    return F.when(a == b, 1.0).when(F.least(n, m) < F.greatest(n, m) * least, 0.0).otherwise(shared / (n + m - shared))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds the text and fingerprint of the next document by ascending doc_id (after the last: the first).

    The order is cut at quantiles of doc_id into parts of about equal size, each in one task. The first document of a part
    also goes to the part before, behind all its own, so one shuffle and one window do. Only the parts' bounds and first
    doc_ids come to the driver. Null doc_ids come first; equal ones are ordered by their texts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(MOST_PARTS, max(size // PART_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds)) or [0]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    part = F.size(F.filter(longs(bounds), lambda b: b <= F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part)
    firsts = sorted(docs.groupBy(part.alias("part")).agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    low, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for k, r in enumerate(firsts):
        low[r.part], before[r.part] = None if r.nulls else r.low, firsts[k - 1].part
    first = F.col("doc_id").eqNullSafe(F.get(longs(low), F.col("part")))
    own, ahead = F.struct(F.col("part"), F.lit(0).alias("after")), F.struct(F.get(longs(before), F.col("part")).cast("int").alias("part"), F.lit(1).alias("after"))
    rows = docs.withColumn("part", part).withColumn("at", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))))
    within = Window.partitionBy("at.part").orderBy("at.after", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next", F.lead(F.struct("text", "print")).over(within)).where("at.after = 0").select("doc_id", "text", "print", "next")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every text.

    The edited text has the last quarter of its characters replaced by the first ones of the next document. Null texts are
    empty. Two texts without words have equal fingerprints and a likeness of 1. Repeated rows are documents of their own;
    extra columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("print", fingerprint(F.col("text"))))
    n, last = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    change = F.concat(F.substr("text", F.lit(1), n - last), F.substr(F.col("next.text"), F.lit(1), last))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), change.alias("edited"), "print", F.col("next.print").alias("next_print"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), "edited_fingerprint",
                       likeness(F.col("print"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id. Classes are the components of links of likeness ``least`` or more.

    Sets are partitioned by length in steps of 1 / least, so alike ones lie in one partition or two that touch. In each
    partition, sets meet in buckets of their first signatures (more of the sorted ones than a pair can differ in) and are
    compared with the smallest of the bucket. Equal fingerprints are one node.
    """
    rows = cut(docs.select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("print")))
    sets = rows.groupBy("print").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("print")).withColumn("n", F.length("print") / 8)
    level = F.floor(F.log(F.col("n")) / math.log(1 / least)).cast("int") if least < 1 else F.col("n").cast("int")
    starts = F.slice(parts(F.col("print")), F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    keyed = sets.select("node", F.explode(F.array(level, level + 1)).alias("level"), starts.alias("s")).select("node", "level", F.explode("s").alias("s"))
    keyed = keyed.select("node", F.xxhash64("level", "s").alias("bucket"))
    smallest = keyed.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z")
    pairs = keyed.join(smallest, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("print").alias("print_b")), "b")
    pairs = salted_join(pairs, "a", sets.select(F.col("node").alias("a"), F.col("print").alias("print_a")), "inner")
    roots = components(pairs.where(likeness(F.col("print_a"), F.col("print_b"), least) >= least).select("a", "b"))
    known = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = salted_join(known.select("print", "root"), "root", known.groupBy("root").agg(F.min("first").alias("class_id"))).select("print", "class_id")
    return salted_join(rows, "print", known).select("doc_id", "class_id")
