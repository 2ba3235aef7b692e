"""One-permutation MinHash fingerprints in DataFrame functions only.

Five-word shingles are hashed once; the top bits of a hash choose its bin and
each bin keeps its least hash. An empty bin b takes the value of the filled
bin j of least hash(b, j), the order in which optimal densification probes. A
fingerprint keeps the low eight bits of each bin; likeness is the share of
equal bins, corrected for chance equality of eight bits.

Cases: null text counts as empty. Up to five words are one shingle, none
included (so wordless texts are alike). Repeated rows and repeated ids stay;
among equal ids the hash of the text orders. Missing ids come last. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
BLANKS = r"[\x20\x09-\x0D]+"
#: Groups of neighbouring ids, at most; and the documents that a group should hold.
GROUPS, GROUP_ROWS = 4096, 500
LEAST = -(1 << 63)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column) -> Column:
    """Hashes of the word shingles of ``text``, one at least."""
    words = F.split(F.trim(F.regexp_replace(text, BLANKS, " ")), " ")

    def over(h):
        run = F.transform(F.sequence(F.lit(1), F.size(h) - (WORDS - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(-1, WORDS - 1)]))
        return F.when(F.size(h) > WORDS, run).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def bin_minima(hashes: Column) -> Column:
    """The least hash of each filled bin, by bin."""
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def signature(text: Column) -> Column:
    """Low bits of each bin after densification: array<tinyint> of BINS entries."""

    def dense(minima):
        def fill(bins):
            def at(b):
                own = F.array_position(bins, b)
                probe = F.array_min(F.transform(bins, lambda j, i: F.xxhash64(b, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("long"))))
                return F.get(minima, F.when(own > 0, own - 1).otherwise(probe.bitwiseAND(F.lit(BINS - 1).cast("long"))).cast("int"))

            every = F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long"))
            return F.when(F.size(minima) == BINS, minima).otherwise(F.transform(every, at))

        return let(F.transform(minima, lambda x: F.shiftright(x, 64 - BIN_BITS)), fill)

    full = let(bin_minima(shingle_hashes(text)), dense)
    return F.transform(full, lambda v: (v.bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - 128).cast("tinyint"))


def packed(sig: Column) -> Column:
    """The fingerprint: two lower-case hex digits for each bin."""
    return F.lower(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v.cast("long") + 128), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""
    return docs.select("doc_id", packed(signature(F.coalesce(F.col("text"), F.lit("")))).alias("fingerprint"))


def _group_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = F.size(F.filter(longs([p[0] for p in parts]), lambda x: x <= key))
    inner = F.get(F.array(*map(longs, parts)), first - 1)
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(inner, lambda x: x <= key)))


def with_next(docs: DataFrame, *values: str) -> DataFrame:
    """Each row with next_<value> of the next document by descending id; after the last comes the first.

    Ids are dealt into groups of neighbours by approximate quantiles. The
    greatest id of each group also stands, as a guest, at the end of the group
    above, so that no group needs another. Only the quantiles and one row a
    group, GROUPS at most, reach the driver.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(LEAST)))
    count = keyed.count()
    want = max(1, min(GROUPS, count // GROUP_ROWS))
    marks = [k / want for k in range(1, want)]
    bounds = keyed.agg(F.percentile_approx("_key", marks, F.lit(10 * GROUPS))).first()[0] if marks else []
    grouped = keyed.withColumn("_group", _group_of(F.col("_key"), sorted(set(bounds or []))))
    tops = sorted(tuple(r) for r in grouped.groupBy("_group").agg(F.max("_key")).collect())
    guests = [(key, above[0], False) for (_, key), above in zip(tops, tops[1:], strict=False)]
    guests += [(tops[-1][1], tops[0][0], True)] if tops else []
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_to", T.IntegerType()), T.StructField("_wrap", T.BooleanType())])
    visits = F.broadcast(spark.createDataFrame(guests, schema).groupBy("_key").agg(F.collect_list(F.struct("_to", "_wrap")).alias("_visits")))
    own = F.array(F.struct(F.col("_group").alias("_to"), F.lit(False).alias("_wrap"), F.lit(False).alias("_guest")))
    away = F.transform("_visits", lambda v: F.struct(v["_to"].alias("_to"), v["_wrap"].alias("_wrap"), F.lit(True).alias("_guest")))
    spread = grouped.join(visits, "_key", "left").withColumn("_place", F.explode(F.when(F.col("_visits").isNull(), own).otherwise(F.concat(own, away))))
    order = Window.partitionBy("_place._to").orderBy("_place._wrap", "_place._guest", F.desc("_key"), F.xxhash64("text"))
    nexts = [F.lead(v).over(order).alias(f"next_{v}") for v in values]
    return spread.select("*", *nexts).filter("NOT _place._guest").select(*docs.columns, *[f"next_{v}" for v in values])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text, and the likeness to that and to the next document.

    The edited text has the last third replaced by the first code points of
    the next document by descending id.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("sig", signature(F.col("text")))
    both = with_next(own, "text", "sig")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    both = both.withColumn("edited_sig", signature(F.col("edited")))
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
