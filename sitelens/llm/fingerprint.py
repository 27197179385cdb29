"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Every 5-word shingle of a text is hashed once; the top bits choose one of ``bins``
bins, and a bin keeps its smallest hash.  A bin that stays empty takes the value
of the first non-empty bin in a pseudo-random sequence of its own (optimal
densification: the sequences are the same for every text, so two texts whose
chosen bins agree borrow alike).  The fingerprint is the low-order ``bits`` of every bin,
packed as hex.  The likeness of two fingerprints is the share of equal bins,
corrected for agreement by chance: (share - 2^-bits) / (1 - 2^-bits).

A text of one to four words has its whole word sequence as its only shingle; a
null or wordless text has the empty fingerprint, which is like itself (1.0) and
unlike any other (0.0).  Everything about one text is computed within its row.
"""

from __future__ import annotations

import random

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, text_or_empty, words

SHINGLE = 5
SEED = 11                                  # of the donors' order
BINS = 256                                 # a power of two
BITS = 8                                   # a multiple of four


def _bin(h: Column, bins: int) -> Column:
    return F.shiftrightunsigned(h, 64 - (bins.bit_length() - 1)).cast("int")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _donors(bins: int) -> list[list[int]]:
    """For every round and bin, the bin that is asked if this one is still empty.

    Unrolled, r rounds give each bin a fixed sequence of 2^r bins to ask, the same
    for every text.  The first rounds are random; the last ones flip one bit of the
    bin number each, so every bin is asked in the end.
    """
    rng, levels = random.Random(SEED), bins.bit_length() - 1
    return [rng.sample(range(bins), bins) for _ in range(levels + 4)] + [
        [b ^ (1 << i) for b in range(bins)] for i in range(levels)]


def with_fingerprint(df: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add the fingerprint of the non-null text column ``text`` as ``out``."""
    w, h, slots = f"__{out}_w", f"__{out}_h", f"__{out}_slots"
    df = df.withColumn(w, words(F.col(text)))
    n = F.size(w)
    # Words are fetched one by one: slice() copies the whole array first, for every shingle.
    hashes = (F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE),
                                               lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])))
              .when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>")))
    # One mark per bin, above all its hashes: sorted, the first of each run of equal bins is the bin's minimum, or
    # the mark of an empty bin.
    width = 64 - (bins.bit_length() - 1)
    full = (1 << width) - 1
    df = df.withColumn(h, F.sort_array(F.concat(hashes, _ints([_signed(b << width | full) for b in range(bins)], "bigint"))))
    first = F.filter(h, lambda x, i: (i == 0) | (_bin(x, bins) != _bin(F.get(F.col(h), i - 1), bins)))
    df = df.withColumn(slots, F.transform(first, lambda x: F.when(
        x.bitwiseAND(F.lit(full)) != full, x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))))
    rounds = _donors(bins)
    donor = _ints([d for r in rounds for d in r], "int")
    filled = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(rounds) - 1)), F.col(slots),
        lambda row, r: F.when(F.exists(row, lambda x: x.isNull()), F.transform(
            row, lambda x, b: F.coalesce(x, F.get(row, F.get(donor, r * bins + b))))).otherwise(row))
    packed = F.array_join(F.transform(filled, lambda v: F.lpad(F.hex(v), bits // 4, "0")), "")
    df = df.withColumn(out, F.when(F.size(w) > 0, packed).otherwise(F.lit("")))
    return df.drop(w, h, slots)


def _ints(values: list[int], kind: str) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    digits, chance = bits // 4, 2.0 ** -bits
    part = lambda c, i: F.substring(F.col(c).cast("binary"), i * digits + 1, F.lit(digits))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda acc, i: acc + F.when(
        part(a, i) == part(b, i), 1).otherwise(0))
    corrected = (same / bins - chance) / (1 - chance)
    return (F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), corrected)))


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """Add ``p``: the number of the key range a row falls in (nulls: -1).

    The ranges come from range partitioning the keys alone; one bound per range
    reaches the driver, and rows find their range by binary search in the JVM.
    """
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # As doubles: monotone in the key, so ranges stay in order even beyond 2^53.
    keys = df.select(F.col(key).cast("double").alias("k")).filter("k IS NOT NULL").repartitionByRange(n, "k")
    tops = keys.groupBy(F.spark_partition_id().alias("r")).agg(F.max("k").alias("k"))
    inner = sorted({r["k"] for r in tops.collect()})[:-1]
    if not inner:                              # one key or none: one range
        return df.withColumn("p", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__d", outputCol="__p", handleInvalid="keep")
    out = cut.transform(df.withColumn("__d", F.col(key).cast("double")))
    return out.withColumn("p", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(
        F.coalesce(F.col("__p").cast("int"), F.lit(-1)))).drop("__d", "__p")


def with_follower(rows: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each column in ``carry``: its value in the next row by (key, tie), nulls first.

    The first row follows the last.  Rows are shuffled once, to their range; only
    the first row of each range crosses to the range before it.
    """
    ranged = in_ranges(rows, key)
    order = Window.partitionBy("p").orderBy(F.col(key).asc_nulls_first(), F.col(tie))
    # The first rows are told by lag, not by number: both uses of the window then share one shuffle of the texts.
    ring = ranged.select("p").distinct()                              # one row per range
    ranged = ranged.select("*", F.lag(F.lit(1)).over(order).alias("__before"),
                           *[F.lead(c).over(order).alias(f"next_{c}") for c in carry],
                           F.lead(F.lit(1)).over(order).alias("__has"))
    firsts = ranged.filter("__before IS NULL").select(F.col("p").alias("q"), *[F.col(c).alias(f"__first_{c}") for c in carry])
    over = Window.orderBy("p")
    ring = ring.select("p", F.coalesce(F.lead("p").over(over), F.first("p").over(over)).alias("q"))
    cross = ring.join(firsts, "q").drop("q")
    joined = ranged.join(cross, "p", "left")
    return joined.select(*rows.columns, *[
        F.when(F.col("__has").isNull(), F.col(f"__first_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
        for c in carry])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS,
                 bits: int = BITS) -> DataFrame:
    """Fingerprint of every text, of its edited text, and both likenesses.

    The edited text has its last floor(n / 4) code points replaced by the first as
    many (or all) of the next document in ascending order of the key.  Null texts
    are empty; null keys come first; rows with equal keys are ordered by text; a
    lone document follows itself; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    rows = with_fingerprint(rows, "t", "fingerprint", bins, bits)
    rows = with_follower(rows, "k", "t", ["t", "fingerprint"])
    n = F.length("t")
    take = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("t").substr(F.lit(1), n - take),
                                              F.col("next_t").substr(F.lit(1), take)))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", bins, bits)
    return rows.select(
        F.col("k").alias(key), F.length("t").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", bins, bits).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", bins, bits).alias("near_next"))
