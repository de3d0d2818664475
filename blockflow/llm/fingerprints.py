"""One-permutation MinHash fingerprints of documents, in DataFrame functions alone.

Hashes of five-word shingles fall into BINS bins by their low bits; a bin keeps
its least hash. An empty bin borrows from the bins that are not (optimal
densification): its own sequence of hashed bins is tried, and after TRIES
misses the non-empty bin that hashes least for it is taken. Of every bin
four bits are kept, a hexadecimal digit each, and the chance that unlike
values agree in them is taken out of the likeness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let, span, words_of

BINS, BITS, TRIES = 256, 4, 16
PER_LONG = 64 // BITS
#: Bits of a hash kept in its bin; all ones mark an empty bin.
DEPTH = 48
EMPTY = (1 << DEPTH) - 1
#: Rows in a bucket of neighbouring ids; beyond BUCKETS of them, buckets grow.
BUCKET_ROWS, BUCKETS = 2000, 10_000


def fingerprint(text: Column, words: int = 5) -> Column:
    """BINS packed values of BITS bits; none for a text without words. With fewer words than a shingle has, the whole sequence is one."""

    def shingles(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
        return F.when(F.size(w) < words, whole).otherwise(let(hashes, lambda h: F.transform(span(0, F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))))

    def binned(grams: Column) -> Column:
        own = F.transform(grams, lambda g: F.shiftleft(F.pmod(g, F.lit(BINS)), DEPTH).bitwiseOR(F.shiftrightunsigned(g, 64 - DEPTH)))
        marks = F.array(*[F.lit((b << DEPTH) | EMPTY).cast("long") for b in range(BINS)])  # so that every bin is there
        first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, DEPTH) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), DEPTH)))
        return F.transform(let(F.sort_array(F.concat(own, marks)), first), lambda x: x.bitwiseAND(F.lit(EMPTY)))

    def densified(bins: Column) -> Column:
        full = F.filter(F.transform(bins, lambda v, j: F.struct(v.alias("v"), j.alias("j"))), lambda x: x["v"] != EMPTY)

        def filled(f: Column) -> Column:
            def borrowed(i: Column) -> Column:
                tries = [F.nullif(F.get(bins, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")), F.lit(EMPTY)) for t in range(TRIES)]
                return F.coalesce(*tries, F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(i, x["j"]).alias("h"), x["v"].alias("v"))))["v"])

            return F.transform(bins, lambda v, i: F.when(v != EMPTY, v).otherwise(borrowed(i)))

        return let(full, filled)

    def packed(bins: Column) -> Column:
        # bins that borrowed the same value still agree by chance each on its own, as the bin is hashed along
        bins = F.transform(bins, lambda v, i: F.xxhash64(v, i).bitwiseAND(F.lit((1 << BITS) - 1)))
        return let(bins, in_longs)

    def in_longs(bins: Column) -> Column:
        one = lambda k: F.aggregate(F.slice(bins, k * PER_LONG + 1, F.lit(PER_LONG)), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    return let(words_of(F.lower(text)), lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(let(let(let(shingles(w), binned), densified), packed)))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint in hexadecimal digits, one a bin; "" for that of a text without words."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two fingerprints; 1 if neither has words, 0 if one hasn't."""

    def unlike(acc: Column, k: Column) -> Column:
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return acc + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    agree = 1 - F.aggregate(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), F.lit(0), unlike) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below key (0 for null), by two levels of comparison."""
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    top = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    low = F.array(*[F.array(*[F.lit(b).cast("long") for b in r]) for r in rows])
    count = lambda a: F.size(F.filter(a, lambda x: x <= key))
    return let(count(top), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * wide + count(F.get(low, k - 1))))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    A row's next is the one after it by doc_id descending (null ids last, equal
    ids by text descending), the last row's the first; a single row is its own.
    The edited text has the last floor(n_chars/2) code points replaced by the
    next one's first as many, or all it has. A null text counts as empty; other
    columns are not read; an empty table gives no rows.

    Neighbours are found in buckets of the ids' quantiles: each bucket also gets
    the first row of the bucket below, so no order over the whole table is made."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    buckets = min(BUCKETS, max(1, math.ceil(total / BUCKET_ROWS)))
    bounds: list[int] = []
    if buckets > 1:
        at = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
        bounds = sorted(set(at or []))
    own = _bucket(F.col("doc_id"), bounds)
    heads = {r[0]: r[1] for r in rows.select(own.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id")).collect()}
    filled = sorted(heads)
    above = {b: filled[(k + 1) % len(filled)] for k, b in enumerate(filled)}
    slots = range(len(bounds) + 1)
    head = F.get(F.array(*[F.lit(heads.get(b)).cast("long") for b in slots]), F.col("bucket"))
    up = F.get(F.array(*[F.lit(above.get(b, b)).cast("int") for b in slots]), F.col("bucket"))
    marked = rows.select("doc_id", "text", fingerprint(F.col("text")).alias("fp"), own.alias("bucket"))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    also = F.struct(up.alias("bucket"), F.lit(1).alias("guest"))
    dealt = marked.select("doc_id", "text", "fp", F.explode(F.when(F.col("doc_id").eqNullSafe(head), F.array(here, also)).otherwise(F.array(here))).alias("p")).select("doc_id", "text", "fp", "p.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    n = F.length("text")
    paired = dealt.select("doc_id", "text", "fp", "guest", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("guest = 0")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substr("next_text", F.lit(1), F.floor(n / 2).cast("int")))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("fp"))).alias("e"))
    return out.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("e.fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("e.fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
