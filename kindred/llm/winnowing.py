"""Document fingerprints by winnowing, in DataFrame expressions only.

Every k consecutive words hash to a gram, by the polynomial of their hashes that a rolling hash (Karp and Rabin) keeps; an
array expression can't carry a running value, so the polynomials of 1, 2, 4 .. words are joined to those of k. Of every `window` consecutive grams the one of least hash is chosen, the
rightmost at ties; a fingerprint is the chosen (hash, position) pairs in order. Two texts that share
window + k - 1 words in a row share a chosen gram (the match guarantee), and positions say where. Words are the parts
of the lower-cased text between white space. A text of fewer than k words is one gram; a text without words (or null)
has the empty fingerprint.

Defined results: likeness of two empty fingerprints is 1. A document's next one follows in the order of (doc_id, text),
nulls first; repeated ids are separate documents; the last one's next is the first, and a sole document is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
WINDOW = 8
POSITIONS = (1 << 31) - 1
#: the polynomials' prime modulus and base
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: rows in a bucket of the order by id, and the most buckets; both bound what the driver holds, not what is computed
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<bigint>: for each chosen gram its hash (31 bits) above POSITIONS less its position, in order of position."""
    if k < 1 or window < 1:
        raise ValueError("k and window must be at least 1")
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\r\f\x0b"))

    def keyed(gram: Column, i: Column | int) -> Column:
        return F.shiftleft(gram, 32) + (F.lit(POSITIONS).cast("bigint") - i)

    def rolled(h: Column, body: Callable[[Column], Column]) -> Column:
        """body(polynomials of the k hashes from each place on); null where there are fewer."""

        def grown(p: Column, n: int) -> Column:
            if n == k:
                return body(p)
            return let(joined(p, n, p, n), lambda q: grown(q, 2 * n)) if 2 * n <= k else rest(p, n, k - n)

        def rest(p: Column, n: int, more: int) -> Column:  # the further `more` hashes one power of two after the other
            if not more:
                return body(p)
            return tail(h, 1, lambda q, m: let(joined(p, n, q, m), lambda r: rest(r, n + m, more - m)), more)

        def tail(p: Column, n: int, then: Callable[[Column, int], Column], most: int) -> Column:
            return let(joined(p, n, p, n), lambda q: tail(q, 2 * n, then, most)) if 2 * n <= most else then(p, n)

        return grown(h, 1)

    def joined(a: Column, n: int, b: Column, m: int) -> Column:
        return F.transform(a, lambda x, i: (x * F.lit(pow(BASE, m, PRIME)).cast("bigint") + F.get(b, i + n)) % F.lit(PRIME).cast("bigint"))

    def grams(h: Column) -> Column:
        each = rolled(h, lambda p: F.transform(F.slice(p, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))), keyed))
        whole = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: (acc * F.lit(BASE).cast("bigint") + x) % F.lit(PRIME).cast("bigint"))
        return F.when(F.size(h) >= k, each).otherwise(F.array(keyed(whole, 0)))

    def minima(keys: Column, reach: int) -> Column:
        """keys: at each place the least of `reach` from there on; a pass triples that at most, until it is `window`."""
        if reach == window:
            return F.array_distinct(F.slice(keys, F.lit(1), F.greatest(F.size(keys) - (window - 1), F.lit(1))))
        steps = sorted({min(reach, window - reach), min(2 * reach, window - reach)})
        return let(F.transform(keys, lambda x, i: F.least(x, *(F.get(keys, i + s) for s in steps))), lambda more: minima(more, steps[-1] + reach))

    own = let(F.transform(F.split(trimmed, "\\s+"), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME).cast("bigint"))), lambda h: let(grams(h), lambda keys: minima(keys, 1)))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<bigint>")).otherwise(own)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32)))


def as_text(fingerprint: Column) -> Column:
    """`hash:position` of each chosen gram, hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat(F.hex(F.shiftright(v, 32)), F.lit(":"), (F.lit(POSITIONS).cast("bigint") - v.bitwiseAND(F.lit((1 << 32) - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the chosen hashes; a and b: arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def bucketed(documents: DataFrame) -> tuple[DataFrame, int]:
    """documents with `bucket` (ids in one bucket are below those of the next) and `ghost`: the first id's rows of each
    bucket also stand, as ghosts, behind the bucket before; those of the first bucket behind the last."""
    n, low = documents.agg(F.count("*"), F.min("doc_id")).first()
    wanted = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds: list[int] = [] if low is None else [low]
    if wanted > 1 and low is not None:
        more = documents.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 4 * wanted)).first()[0]
        bounds = sorted({low, *more})
    last, side = max(0, len(bounds) - 1), max(1, int(len(bounds) ** 0.5))
    # as text, which is folded into one constant however many there are
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    # two steps: among every side-th bound, then among the side bounds from there
    coarse, fine = array(bounds[::side]), array(bounds)
    rank = let(F.greatest(F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0)) * side, lambda at: at + F.size(F.filter(F.slice(fine, at + 1, F.lit(side)), lambda b: b <= F.col("doc_id"))) - 1)
    found = F.when(F.col("doc_id").isNull() | F.lit(not bounds), F.lit(0)).otherwise(rank)
    out = documents.withColumn("bucket", found)
    first = F.when(F.col("bucket") == 0, F.col("doc_id").isNull() | (F.col("doc_id") == F.lit(low))).otherwise(F.col("doc_id") == F.get(fine, F.col("bucket")))
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    places = F.when(first, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(before.alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))))
    return out.withColumn("place", F.explode(places)).drop("bucket").select("*", "place.bucket", "place.ghost").drop("place"), last + 1


def with_next(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_chars, edited, fp, edited_fp, next_fp. The texts are shuffled once, by bucket of id; the texts and
    then the fingerprints of the next documents come from windows over that one partitioning."""
    rows, _ = bucketed(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("fp", chosen(F.col("text"), k, window))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - half)"), F.expr("left(coalesce(next_text, ''), half)"))).drop("next_text")
    rows = rows.withColumn("next_fp", F.lead("fp").over(order)).where("not ghost")
    return rows.withColumn("edited_fp", chosen(F.col("edited"), k, window)).drop("bucket", "ghost", "half")


def digest(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    rows = with_next(documents, k, window)
    rows = rows.withColumn("own", hashes(F.col("fp"))).withColumn("other", hashes(F.col("edited_fp"))).withColumn("following", hashes(F.col("next_fp")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
