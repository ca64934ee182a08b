"""Tag features: weights, top tags, vocabulary, shared tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import CATEGORY_WEIGHTS
from kindred.functions.columns import doubles, idf, l2_normalize, let, multiplier, tokens


def tag_positions(posts: DataFrame) -> DataFrame:
    """post_id, pos, tag: one row for each occurrence, in the order of the string."""
    return posts.select(F.col("id").alias("post_id"), F.posexplode(tokens(F.col("tag_string"))).alias("pos", "tag"))


def counted_tags(posts: DataFrame) -> DataFrame:
    """post_id, tag, n_occ, first_pos: one row for each distinct tag of a row of posts, without a shuffle. Positions are
    sorted by tag, and the runs of equal tags counted."""
    placed = F.sort_array(F.transform(tokens(F.col("tag_string")), lambda t, i: F.struct(t.alias("tag"), i.alias("pos"))))

    def runs(a: F.Column) -> F.Column:
        starts = F.filter(F.transform(a, lambda x, i: F.struct(x["tag"].alias("tag"), x["pos"].alias("pos"), i.alias("at"), (F.get(a, i - 1)["tag"] == x["tag"]).alias("again"))), lambda x: ~F.coalesce(x["again"], F.lit(False)))
        return let(starts, lambda r: F.transform(r, lambda x, i: F.struct(x["tag"].alias("tag"), (F.coalesce(F.get(r, i + 1)["at"], F.size(a)) - x["at"]).cast("bigint").alias("n_occ"), x["pos"].alias("first_pos"))))

    return posts.select(F.col("id").alias("post_id"), F.explode(let(placed, runs)).alias("t")).select("post_id", "t.tag", "t.n_occ", "t.first_pos")


def token_counts(posts: DataFrame) -> DataFrame:
    t = tokens(F.col("tag_string"))
    return posts.select("id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def without(tag_rows: DataFrame, excluded: frozenset[str] | set[str]) -> DataFrame:
    return tag_rows.where(~F.col("tag").isin(sorted(excluded))) if excluded else tag_rows


def weighted(posts: DataFrame, tags: DataFrame, n_posts: int, excluded: frozenset[str] = frozenset(), weights: dict[int, float] | None = None) -> DataFrame:
    """post_id, tag, category, n_occ, first_pos, unit, weight: one row for each tag of a post that counts. An unknown tag
    has category 0 and a post count of 1; a weight of exactly 0 leaves the tag out; repeats add up."""
    meta = tags.select(F.col("name").alias("tag"), "category", "post_count")
    rows = without(tag_positions(posts), excluded).groupBy("post_id", "tag").agg(F.count("*").alias("n_occ"), F.min("pos").alias("first_pos"))
    rows = rows.join(meta, "tag", "left").withColumn("category", F.coalesce("category", F.lit(0))).withColumn("post_count", F.coalesce("post_count", F.lit(1)))
    mult = multiplier(F.col("category"), CATEGORY_WEIGHTS if weights is None else weights)
    rows = rows.withColumn("unit", mult * idf(n_posts, F.col("post_count"))).where(mult != 0)
    return rows.select("post_id", "tag", "category", "n_occ", "first_pos", "unit", (F.col("unit") * F.col("n_occ")).alias("weight"))


def top_tags(weights: DataFrame, n: int) -> DataFrame:
    """The n heaviest tags of each post with their rank; at ties the one that comes first in the string."""
    rn = F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc("weight"), "first_pos"))
    return weights.withColumn("rn", rn).where(F.col("rn") <= n)


def vocabulary(weights: DataFrame, order: list[str] | None = None) -> DataFrame:
    """tag_id, tag: ids from 0 in order of first appearance. weights needs the columns of `order` (post order) and
    first_pos. The one ordered task sees each distinct tag once."""
    order = order or ["post_id"]
    first = weights.groupBy("tag").agg(F.min(F.struct(*order, "first_pos")).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).cast("bigint").alias("tag_id"), "tag")


def grow_vocabulary(vocab: DataFrame, weights: DataFrame, order: list[str]) -> DataFrame:
    """vocab with new tags behind its ids, and is_new."""
    new = vocabulary(weights.join(vocab, "tag", "left_anti"), order)
    size = vocab.agg(F.count("*").alias("size"))
    return vocab.select("tag_id", "tag", F.lit(False).alias("is_new")).unionByName(new.crossJoin(F.broadcast(size)).select((F.col("tag_id") + F.col("size")).alias("tag_id"), "tag", F.lit(True).alias("is_new")))


def as_arrays(top: DataFrame, vocab: DataFrame) -> DataFrame:
    """post_id, tags array<struct<tag_id, weight>> in order of tag_id, weights in single precision."""
    rows = top.join(vocab, "tag").select("post_id", F.struct(F.col("tag_id").cast("int").alias("tag_id"), F.col("weight").cast("float").alias("weight")).alias("t"))
    return rows.groupBy("post_id").agg(F.sort_array(F.collect_list("t")).alias("tags"))


def shared(left: DataFrame, right: DataFrame, m: int) -> DataFrame:
    """left and right: key, tag_id, weight. (left key, right key, rank, tag_id, weight): the m tags in both of highest
    least weight, ties to the smaller id."""
    both = left.select(F.col("key").alias("a"), "tag_id", F.col("weight").alias("wa")).join(right.select(F.col("key").alias("b"), "tag_id", F.col("weight").alias("wb")), "tag_id")
    both = both.select("a", "b", "tag_id", F.least("wa", "wb").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("weight"), "tag_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= m)


def shared_pair(a: F.Column, b: F.Column, m: int) -> F.Column:
    """As shared(), for two array columns of struct<tag_id, weight> in one row."""
    other = F.map_from_entries(F.transform(b, lambda t: F.struct(t["tag_id"], t["weight"])))
    both = F.filter(F.transform(a, lambda t: F.struct((-F.least(t["weight"], F.try_element_at(other, t["tag_id"]))).alias("order"), t["tag_id"].alias("tag_id"), F.try_element_at(other, t["tag_id"]).alias("there"))), lambda t: t["there"].isNotNull())
    return F.transform(F.slice(F.array_sort(both), 1, m), lambda t: F.struct(t["tag_id"].alias("tag_id"), (-t["order"]).alias("weight"))) if m > 0 else F.filter(a, lambda t: F.lit(False))


def tag_names(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    return ids.join(vocab, "tag_id", "left").select("tag_id", F.coalesce("tag", F.concat(F.lit("tag_"), F.col("tag_id").cast("string"))).alias("tag_name"))


def offsets(top: DataFrame, record: int = 8) -> DataFrame:
    """post_id, start_offset, end_offset of each post's records, were they stored one behind the other. Two levels of
    running sums, so that no task sees all posts."""
    sizes = top.groupBy("post_id").agg((F.count("*") * record).alias("size")).withColumn("part", F.floor(F.col("post_id") / 65536))
    before = sizes.groupBy("part").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    end = F.sum("size").over(Window.partitionBy("part").orderBy("post_id").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("end", end).join(before.select("part", "base"), "part").select("post_id", (F.col("base") + F.col("end") - F.col("size")).cast("bigint").alias("start_offset"), (F.col("base") + F.col("end")).cast("bigint").alias("end_offset"))


def tag_vectors(top: DataFrame, tag_emb: DataFrame) -> DataFrame:
    """post_id, dim, value: sum of weight times tag vector, normalized; zeros if the sum is zero. Tags without a vector
    are skipped. top: post_id, tag_id, weight; tag_emb: tag_id, vec."""
    rows = tag_vector_arrays(top, tag_emb).select("post_id", F.posexplode("vec").alias("dim", "value"))
    return rows.withColumn("dim", F.col("dim").cast("bigint"))


def tag_vector_arrays(top: DataFrame, tag_emb: DataFrame) -> DataFrame:
    """post_id, vec array<double>: as tag_vectors(). One row for each tag of a post is shuffled, not one for each number; a
    post's tags (at most as many as top_tags leaves) are added up in order of tag_id."""
    held = top.join(tag_emb.select("tag_id", doubles(F.col("vec")).alias("vec")), "tag_id").groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("tag_id", F.col("weight").cast("double").alias("weight"), "vec"))).alias("t"))
    zero = F.transform(F.get("t", F.lit(0))["vec"], lambda x: F.lit(0.0))
    total = F.aggregate("t", zero, lambda acc, x: F.zip_with(acc, x["vec"], lambda a, b: a + x["weight"] * b))
    return held.select("post_id", l2_normalize(total).alias("vec"))


def upsert(base: DataFrame, delta: DataFrame, key: str = "post_id") -> DataFrame:
    """base with the rows of delta in place of its own; nothing is deleted."""
    return base.join(delta, key, "left_anti").unionByName(delta)
