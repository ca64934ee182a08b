"""The catalogue of queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.config import WEIGHT_PRESETS
from kindred.functions import columns as C
from kindred.operators import counts, sgd, similarity, tags
from kindred.sources import scans, views
from kindred.sources.views import MULT, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WATERMARK = datetime(2001, 6, 1)
CHANGED = datetime(2001, 9, 1)
DIMS = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def n_posts(s: SparkSession, d: str) -> int:
    return views.table(s, d, "part").count()  # from the footers


def post_weights(s: SparkSession, d: str) -> DataFrame:
    return tags.weighted(views.part_tags(s, d), views.tags(s, d), n_posts(s, d))


def numbered_top(s: SparkSession, d: str, n: int = 100) -> DataFrame:
    """post_id, tag_id, tag, weight of the top tags."""
    w = post_weights(s, d)
    return tags.top_tags(w, n).join(tags.vocabulary(w), "tag").select("post_id", "tag_id", "tag", "weight")


TOP = "top AS (SELECT post_id, tag, weight FROM weights QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY weight DESC, first_pos) <= 100), numbered AS (SELECT post_id, tag_id, tag, weight FROM top JOIN vocab USING (tag))"


# scans


@query(with_views("favorite_events", "SELECT coalesce(max(event_id), 0)::BIGINT AS max_event_id FROM favorite_events"))
def q_max_event_id(s, d):
    return scans.max_event_id(views.favorite_events(s, d))


@query(with_views("posts", "SELECT max(updated_at) AS max_updated_at FROM posts"))
def q_max_updated_at(s, d):
    return scans.max_updated_at(views.posts(s, d))


@query(with_views("stream_events", "SELECT event_id, user_id, post_id, action::BIGINT AS action FROM stream_events WHERE event_id > 100 AND created_at >= TIMESTAMP '2024-01-01' ORDER BY event_id LIMIT 500"))
def q_event_batch(s, d):
    return scans.events_after(views.stream_events(s, d), 100, datetime(2024, 1, 1), 500).select("event_id", "user_id", "post_id", "action")


@query(with_views("stream_events", "SELECT event_id, user_id, post_id, action::BIGINT AS action FROM stream_events WHERE event_id > 100 AND created_at >= TIMESTAMP '2024-01-01'"))
def q_events_after(s, d):
    return scans.events_after(views.stream_events(s, d), 100, datetime(2024, 1, 1)).select("event_id", "user_id", "post_id", "action")


@query(with_views("posts", "SELECT id, tag_string, updated_at FROM posts WHERE updated_at > TIMESTAMP '2001-09-01' OR (updated_at = TIMESTAMP '2001-09-01' AND id > -1) ORDER BY updated_at, id LIMIT 500"))
def q_changed_posts(s, d):
    return scans.changed_posts(views.posts(s, d), CHANGED, -1, 500)


@query(with_views("favorites", "SELECT user_id, post_id FROM favorites WHERE user_id > 5 OR (user_id = 5 AND post_id > 10) ORDER BY user_id, post_id LIMIT 500"))
def q_favorites_page(s, d):
    return scans.favorites_page(views.favorites(s, d), 5, 10, 500)


@query(with_views("tags", "SELECT name, category, post_count FROM tags"))
def q_tag_metadata(s, d):
    return scans.tag_metadata(views.tags(s, d))


@query(with_views("posts", "SELECT count(*) AS n_posts FROM posts"))
def q_post_count(s, d):
    return scans.post_count(views.part_tags(s, d))


@query(with_views("posts", "SELECT id, tag_string FROM posts WHERE id > -1"))
def q_all_posts(s, d):
    return scans.all_posts(views.part_tags(s, d))


# tags


@query(with_views("doc_posts", f"SELECT id, len({views.SPLIT})::BIGINT AS n_tokens, len(list_distinct({views.SPLIT}))::BIGINT AS n_distinct FROM doc_posts"))
def q_tokenize(s, d):
    return tags.token_counts(views.doc_posts(s, d))


@query(with_views("tokens", "SELECT post_id, pos::BIGINT AS pos, tag FROM tokens"))
def q_tag_positions(s, d):
    return tags.tag_positions(views.part_tags(s, d)).withColumn("pos", F.col("pos").cast("bigint"))


@query(with_views("tokens", "SELECT post_id, tag FROM tokens WHERE tag NOT IN ('red', 'PROMO')"))
def q_excluded_tags(s, d):
    return tags.without(tags.tag_positions(views.part_tags(s, d)), {"red", "PROMO"}).select("post_id", "tag")


@query(with_views("weights", "SELECT post_id, tag, category::BIGINT AS category, round(weight, 6) AS weight FROM weights"))
def q_tag_weights(s, d):
    return post_weights(s, d).select("post_id", "tag", F.col("category").cast("bigint").alias("category"), F.round("weight", 6).alias("weight"))


@query(with_views("tags tokens", f"SELECT tag, count(DISTINCT post_id) AS n_posts_dropped FROM tokens JOIN tags ON name = tag WHERE {MULT} = 0 GROUP BY tag"))
def q_invalid_category(s, d):
    dropped = views.tags(s, d).where(C.multiplier(F.col("category"), tags.CATEGORY_WEIGHTS) == 0).select(F.col("name").alias("tag"))
    return tags.tag_positions(views.part_tags(s, d)).join(dropped, "tag").groupBy("tag").agg(F.countDistinct("post_id").alias("n_posts_dropped"))


@query(with_views("tags posts", "SELECT name, round(ln(((SELECT count(*) FROM posts) + 1.0::DOUBLE) / (post_count + 1.0::DOUBLE)) + 1.0, 6) AS idf FROM tags"))
def q_idf(s, d):
    return views.tags(s, d).select("name", F.round(C.idf(n_posts(s, d), F.col("post_count")), 6).alias("idf"))


@query(with_views("vocab", "SELECT i.tag_id, coalesce(v.tag, 'tag_' || i.tag_id) AS tag_name FROM (SELECT unnest(range((SELECT count(*) + 5 FROM vocab))) AS tag_id) i LEFT JOIN vocab v USING (tag_id)"))
def q_tag_names(s, d):
    vocab = tags.vocabulary(post_weights(s, d))
    size = vocab.agg(F.count("*").alias("n"))
    return tags.tag_names(size.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + 4)).alias("tag_id")), vocab)


DOC_SQL = (
    f"t AS (SELECT id AS post_id, unnest({views.SPLIT}) AS tag, unnest(range(len({views.SPLIT}))) AS pos FROM doc_posts), "
    "g AS (SELECT post_id, tag, count(*) AS n_occ, min(pos) AS first_pos FROM t GROUP BY 1, 2), m AS (SELECT tag, count(*) AS post_count FROM g GROUP BY 1), "
    "w AS (SELECT post_id, tag, n_occ, first_pos, (ln(((SELECT count(*) FROM doc_posts) + 1.0::DOUBLE) / (post_count + 1.0::DOUBLE)) + 1.0) * n_occ AS weight FROM g JOIN m USING (tag))"
)


def doc_weights(s: SparkSession, d: str) -> DataFrame:
    """Words of documents as tags, all of category 0, post counts from the data. A document is one row, so its repeats are
    counted in the row; only the post counts need a shuffle of words, summed up before it."""
    posts = views.doc_posts(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "id")  # texts once, not their words
    rows = tags.counted_tags(posts)
    meta = rows.groupBy("tag").agg(F.count("*").alias("post_count"))
    unit = C.multiplier(F.lit(0), tags.CATEGORY_WEIGHTS) * C.idf(views.table(s, d, "documents").count(), F.col("post_count"))
    return rows.join(meta, "tag").select("post_id", "tag", "n_occ", "first_pos", (unit * F.col("n_occ")).alias("weight"))


@query(with_views("doc_posts", "SELECT post_id, tag, n_occ, round(weight, 6) AS weight FROM w", DOC_SQL))
def q_dup_tags(s, d):
    return doc_weights(s, d).select("post_id", "tag", "n_occ", F.round("weight", 6).alias("weight"))


@query(with_views("doc_posts", "SELECT post_id, tag, row_number() OVER (PARTITION BY post_id ORDER BY weight DESC, first_pos) AS rn, round(weight, 6) AS weight FROM w QUALIFY rn <= 100", DOC_SQL))
def q_top_tags(s, d):
    return tags.top_tags(doc_weights(s, d), 100).select("post_id", "tag", F.col("rn").cast("bigint").alias("rn"), F.round("weight", 6).alias("weight"))


@query(with_views("vocab", "SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY tag_id) - 1 AS idx, tag_id, round(weight, 6) AS weight FROM t3 JOIN vocab USING (tag)", "t3 AS (SELECT * FROM weights QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY weight DESC, first_pos) <= 3)"))
def q_top_tags_array(s, d):
    w = post_weights(s, d)
    rows = tags.top_tags(w, 3).join(tags.vocabulary(w), "tag").groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("tag_id", "weight"))).alias("tags"))
    return rows.select("post_id", F.posexplode("tags").alias("idx", "t")).select("post_id", F.col("idx").cast("bigint").alias("idx"), "t.tag_id", F.round("t.weight", 6).alias("weight"))


@query(with_views("vocab", "SELECT count(*) AS vocab_size FROM vocab"))
def q_vocab_size(s, d):
    return post_weights(s, d).agg(F.countDistinct("tag").alias("vocab_size"))


@query(with_views("vocab", "SELECT tag_id, tag FROM vocab"))
def q_vocab(s, d):
    return tags.vocabulary(post_weights(s, d))


@query(
    with_views(
        "weights",
        "SELECT tag_id, tag, false AS is_new FROM old UNION ALL SELECT row_number() OVER (ORDER BY m) - 1 + (SELECT count(*) FROM old) AS tag_id, tag, true AS is_new FROM "
        "(SELECT tag, min(struct_pack(u := updated_at, i := post_id, f := first_pos)) AS m FROM weights JOIN posts ON id = post_id WHERE post_id >= 100 AND tag NOT IN (SELECT tag FROM old) GROUP BY tag)",
        "old AS (SELECT row_number() OVER (ORDER BY m) - 1 AS tag_id, tag FROM (SELECT tag, min(struct_pack(i := post_id, f := first_pos)) AS m FROM weights WHERE post_id < 100 GROUP BY tag))",
    )
)
def q_vocab_incremental(s, d):
    w = post_weights(s, d)
    later = w.where("post_id >= 100").join(views.posts(s, d).select(F.col("id").alias("post_id"), "updated_at"), "post_id")
    return tags.grow_vocabulary(tags.vocabulary(w.where("post_id < 100")), later, ["updated_at", "post_id"])


@query(with_views("vocab", "SELECT b.post_id, row_number() OVER (PARTITION BY b.post_id ORDER BY least(a.weight, b.weight) DESC, b.tag_id) AS rank, b.tag_id, round(least(a.weight, b.weight), 6) AS weight FROM numbered a JOIN numbered b USING (tag_id) WHERE a.post_id = 0 AND b.post_id <> 0 QUALIFY rank <= 6", TOP))
def q_shared_tags(s, d):
    t = numbered_top(s, d).withColumnRenamed("post_id", "key")
    rows = tags.shared(t.where("key = 0"), t.where("key <> 0"), 6)
    return rows.select(F.col("b").alias("post_id"), F.col("rank").cast("bigint").alias("rank"), "tag_id", F.round("weight", 6).alias("weight"))


@query(with_views("vocab", "SELECT post_id, (sum(n) OVER (ORDER BY post_id) - n)::BIGINT AS start_offset, (sum(n) OVER (ORDER BY post_id))::BIGINT AS end_offset FROM (SELECT post_id, 8 * count(*) AS n FROM numbered GROUP BY post_id)", TOP))
def q_top_tags_offsets(s, d):
    return tags.offsets(tags.top_tags(post_weights(s, d), 100))


@query(
    with_views(
        "vocab",
        "SELECT post_id, dim, round(CASE WHEN n > 0 THEN value / n ELSE 0 END, 6) AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY post_id)) AS n FROM v)",
        TOP + ", v AS (SELECT post_id, dim, sum(weight * x) AS value FROM (SELECT post_id, weight, unnest(range(len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM numbered JOIN embeddings ON vec_id = tag_id) GROUP BY 1, 2)",
    )
)
def q_tag_vector(s, d):
    emb = views.cf(s, d).withColumnRenamed("post_id", "tag_id")
    return tags.tag_vectors(numbered_top(s, d), emb).withColumn("value", F.round("value", 6))


# counts


@query(with_views("favorites", "SELECT post_id, count(*) AS fav_count FROM favorites GROUP BY post_id"))
def q_fav_count(s, d):
    return counts.fav_count(views.favorites(s, d))


@query(with_views("favorite_events", "SELECT post_id, (max_by(r, event_id) - least(0, min(r)))::BIGINT AS fav_count FROM (SELECT post_id, event_id, sum(action) OVER (PARTITION BY post_id ORDER BY event_id) AS r FROM favorite_events) GROUP BY post_id"))
def q_fav_count_clamped(s, d):
    return counts.clamped_counts(views.favorite_events(s, d))


@query(with_views("posts", "SELECT greatest(max(updated_at), TIMESTAMP '2001-06-01') AS new_watermark FROM posts"))
def q_posts_watermark(s, d):
    return scans.posts_watermark(views.posts(s, d), WATERMARK)


@query(with_views("favorite_events", "SELECT greatest(0, max(event_id) - 100)::BIGINT AS lag FROM favorite_events"))
def q_event_lag(s, d):
    return scans.event_lag(views.favorite_events(s, d), 100)


# joins and sets

UNIVERSE = "universe AS (SELECT coalesce(a.post_id, b.id) AS post_id, a.post_id IS NOT NULL AS has_cf, b.id IS NOT NULL AS has_tags FROM (SELECT DISTINCT post_id FROM favorites) a FULL OUTER JOIN (SELECT id FROM posts) b ON a.post_id = b.id)"


def universe(s: SparkSession, d: str) -> DataFrame:
    a = views.favorites(s, d).select("post_id").distinct().withColumn("has_cf", F.lit(True))
    b = views.part_tags(s, d).select(F.col("id").alias("post_id"), F.lit(True).alias("has_tags"))
    return a.join(b, "post_id", "full_outer").select("post_id", F.coalesce("has_cf", F.lit(False)).alias("has_cf"), F.coalesce("has_tags", F.lit(False)).alias("has_tags"))


@query(with_views("favorites posts", "SELECT post_id, has_cf, has_tags FROM universe", UNIVERSE))
def q_post_universe(s, d):
    return universe(s, d)


@query(with_views("favorites posts cf", "SELECT post_id, unnest(range(64)) AS dim, unnest(coalesce(vec, list_transform(range(64), lambda x: 0.0::DOUBLE))) AS value FROM universe LEFT JOIN cf USING (post_id)", UNIVERSE))
def q_cf_or_zero(s, d):
    zero = F.array_repeat(F.lit(0.0), DIMS)
    rows = universe(s, d).join(views.cf(s, d), "post_id", "left").select("post_id", F.posexplode(F.coalesce(C.doubles(F.col("vec")), zero)).alias("dim", "value"))
    return rows.withColumn("dim", F.col("dim").cast("bigint"))


@query(with_views("favorites posts", "SELECT post_id, coalesce(n, 0) AS fav_count FROM universe LEFT JOIN (SELECT post_id, count(*) AS n FROM favorites GROUP BY 1) USING (post_id)", UNIVERSE))
def q_fav_counts_aligned(s, d):
    return universe(s, d).join(counts.fav_count(views.favorites(s, d)), "post_id", "left").select("post_id", F.coalesce("fav_count", F.lit(0)).alias("fav_count"))


#: the base is all posts, the delta those that changed since CHANGED
BASE_DELTA = TOP + ", base AS (SELECT post_id, count(*) AS n_tags, 'base' AS source FROM numbered GROUP BY 1), delta AS (SELECT post_id, n_tags, 'delta' AS source FROM base JOIN posts ON id = post_id WHERE updated_at > TIMESTAMP '2001-09-01')"


def base_and_delta(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = tags.top_tags(post_weights(s, d), 100).groupBy("post_id").agg(F.count("*").alias("n_tags"))
    changed = views.posts(s, d).where(F.col("updated_at") > F.lit(CHANGED)).select(F.col("id").alias("post_id"))
    return sizes.withColumn("source", F.lit("base")), sizes.join(changed, "post_id", "left_semi").withColumn("source", F.lit("delta"))


@query(with_views("vocab", "SELECT i.post_id, coalesce(d.n_tags, b.n_tags, 0) AS n_tags, coalesce(d.source, b.source, 'none') AS source FROM (SELECT o_orderkey AS post_id FROM orders) i LEFT JOIN delta d USING (post_id) LEFT JOIN base b USING (post_id)", BASE_DELTA))
def q_get_many(s, d):
    base, delta = base_and_delta(s, d)
    ids = views.table(s, d, "orders").select(F.col("o_orderkey").alias("post_id"))  # more keys than there are posts
    rows = ids.join(delta.select("post_id", F.col("n_tags").alias("dn"), F.col("source").alias("ds")), "post_id", "left").join(base, "post_id", "left")
    return rows.select("post_id", F.coalesce("dn", "n_tags", F.lit(0)).alias("n_tags"), F.coalesce("ds", "source", F.lit("none")).alias("source"))


@query(with_views("vocab", "SELECT coalesce(d.post_id, b.post_id) AS post_id, coalesce(d.source, b.source) AS source, coalesce(d.n_tags, b.n_tags) AS n_tags FROM base b FULL OUTER JOIN delta d USING (post_id)", BASE_DELTA))
def q_upsert_merge(s, d):
    return tags.upsert(*base_and_delta(s, d)).select("post_id", "source", "n_tags")


@query(with_views("vocab", "SELECT post_id FROM base UNION SELECT post_id FROM delta", BASE_DELTA))
def q_key_union(s, d):
    base, delta = base_and_delta(s, d)
    return base.select("post_id").union(delta.select("post_id")).distinct()


# vectors

SQL_DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])), lambda x, y: x + y)"


def sql_dot(a: str, b: str) -> str:
    return SQL_DOT.format(a=a, b=b)


def sql_unit(v: str) -> str:
    return f"CASE WHEN sqrt({sql_dot(v, v)}) > 0 THEN list_transform({v}, lambda t: t / sqrt({sql_dot(v, v)})) ELSE list_transform({v}, lambda t: 0.0::DOUBLE) END"


def sql_cos(a: str, b: str) -> str:
    return f"CASE WHEN sqrt({sql_dot(a, a)}) = 0 OR sqrt({sql_dot(b, b)}) = 0 THEN 0.0 ELSE {sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)})) END"


NORMS = "n AS (SELECT post_id, vec, sqrt(" + sql_dot("vec", "vec") + ") AS norm FROM cf)"
NEAR3 = NORMS + ", near AS (SELECT row_number() OVER (ORDER BY cos DESC, post_id) AS rank, post_id, round(cos, 4) AS score FROM (SELECT a.post_id, CASE WHEN a.norm = 0 OR q.norm = 0 THEN 0.0 ELSE " + sql_dot("a.vec", "q.vec") + " / (a.norm * q.norm) END AS cos FROM n a, n q WHERE q.post_id = 3 AND a.post_id <> 3) QUALIFY rank <= 6)"


@query(with_views("cf", "SELECT rank, post_id, score FROM near", NEAR3))
def q_similar(s, d):
    return similarity.similar_to(views.cf(s, d), 3, 6)


@query(with_views("cf", "SELECT rank, post_id, score FROM near WHERE false", NEAR3))
def q_similar_missing(s, d):
    return similarity.similar_to(views.cf(s, d), -1, 6)


@query(with_views("cf", "SELECT q.post_id AS query_id, row_number() OVER (PARTITION BY q.post_id ORDER BY CASE WHEN a.norm = 0 OR q.norm = 0 THEN 0.0 ELSE " + sql_dot("a.vec", "q.vec") + " / (q.norm * a.norm) END DESC, a.post_id) AS rank, a.post_id, round(CASE WHEN a.norm = 0 OR q.norm = 0 THEN 0.0 ELSE " + sql_dot("a.vec", "q.vec") + " / (q.norm * a.norm) END, 4) AS score FROM n q JOIN n a ON a.post_id <> q.post_id QUALIFY rank <= 6", NORMS))
def q_similar_all(s, d):
    v = views.cf(s, d)
    return similarity.similar_all(v, v, 6, 512)


@query(with_views("partners", f"SELECT post_id, unnest(range(64)) AS dim, round(unnest({sql_unit('mixed')}), 6) AS value FROM m", f"u AS (SELECT post_id, {sql_unit('vec')} AS a, {sql_unit('other')} AS b FROM partners), m AS (SELECT post_id, list_transform(list_zip(a, b), lambda z: 1.0 * z[1] + 0.3 * z[2])::DOUBLE[] AS mixed FROM u)"))
def q_hybrid(s, d):
    rows = views.partners(s, d).select("post_id", F.posexplode(C.blend(F.col("vec"), F.col("other"), 1.0, 0.3)).alias("dim", "value"))
    return rows.select("post_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(
    with_views(
        "partners",
        f"SELECT mode, post_id, round(sqrt({sql_dot('h', 'h')}), 6) AS norm, round(h[1], 6) AS first_component FROM (SELECT mode, post_id, {sql_unit('mixed')} AS h FROM m)",
        f"u AS (SELECT post_id, {sql_unit('vec')} AS a, {sql_unit('other')} AS b FROM partners), p(mode, wc, wt) AS (VALUES ('favorites', 1.0::DOUBLE, 0.3::DOUBLE), ('tags', 0.3::DOUBLE, 1.0::DOUBLE)), m AS (SELECT mode, post_id, list_transform(list_zip(a, b), lambda z: wc * z[1] + wt * z[2])::DOUBLE[] AS mixed FROM u, p)",
    )
)
def q_hybrid_modes(s, d):
    presets = s.createDataFrame([(m, float(a), float(b)) for m, (a, b) in WEIGHT_PRESETS.items()], "mode string, wc double, wt double")
    rows = views.partners(s, d).crossJoin(F.broadcast(presets)).select("mode", "post_id", C.blend(F.col("vec"), F.col("other"), F.col("wc"), F.col("wt")).alias("h"))
    return rows.select("mode", "post_id", F.round(C.norm(F.col("h")), 6).alias("norm"), F.round(F.get("h", F.lit(0)), 6).alias("first_component"))


@query(with_views("cf", f"SELECT post_id, round(sqrt({sql_dot('v', 'v')}), 6) AS norm_in, round(sqrt({sql_dot('w', 'w')}), 6) AS norm_out FROM (SELECT post_id, v, {sql_unit('v')} AS w FROM (SELECT post_id, list_transform(vec, lambda t: t * (post_id % 3)) AS v FROM cf))"))
def q_l2_normalize(s, d):
    rows = views.cf(s, d).select("post_id", F.transform(C.doubles(F.col("vec")), lambda x: x * (F.col("post_id") % 3)).alias("v"))
    return rows.select("post_id", F.round(C.norm(F.col("v")), 6).alias("norm_in"), F.round(C.norm(C.l2_normalize(F.col("v"))), 6).alias("norm_out"))


@query(with_views("partners", f"SELECT post_id, partner_id, round({sql_cos('vec', 'other')}, 6) AS cosine FROM partners"))
def q_cosine(s, d):
    return views.partners(s, d).select("post_id", "partner_id", F.round(C.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


@query(with_views("partners", f"SELECT p.post_id, round({sql_cos('p.vec', 'p.other')}, 4) AS cf, round({sql_cos('p.other', 'r.other')}, 4) AS tag FROM partners p JOIN partners r ON r.post_id = p.partner_id"))
def q_score_breakdown(s, d):
    p = views.partners(s, d)
    rows = p.join(p.select(F.col("post_id").alias("partner_id"), F.col("other").alias("theirs")), "partner_id")
    cf, tag = similarity.score_breakdown(F.col("vec"), F.col("other"), F.col("other"), F.col("theirs"))
    return rows.select("post_id", cf.alias("cf"), tag.alias("tag"))


EXPLAIN = TOP + ", " + NEAR3


def explain(s: SparkSession, d: str, post_id: int, limit: int, m: int) -> DataFrame:
    top = numbered_top(s, d)
    near = similarity.similar_to(views.cf(s, d), post_id, limit)
    own = top.where(F.col("post_id") == post_id).select(F.lit(post_id).alias("key"), "tag_id", "weight")
    theirs = top.join(F.broadcast(near.select("post_id")), "post_id").select(F.col("post_id").alias("key"), "tag_id", "weight")
    rows = tags.shared(own, theirs, m).join(tags.vocabulary(post_weights(s, d)), "tag_id")
    return near.join(rows.select(F.col("b").alias("post_id"), F.col("rank").cast("bigint").alias("shared_rank"), "tag"), "post_id").select("post_id", "rank", "score", "shared_rank", "tag")


@query(with_views("vocab cf", "SELECT x.post_id, near.rank, row_number() OVER (PARTITION BY x.post_id ORDER BY least(a.weight, x.weight) DESC, x.tag_id) AS shared_rank, x.tag FROM near JOIN numbered x USING (post_id) JOIN numbered a ON a.post_id = 3 AND a.tag_id = x.tag_id QUALIFY shared_rank <= 6", EXPLAIN))
def q_explain(s, d):
    return explain(s, d, 3, 6, 6).drop("score")


@query(with_views("favorites cf", "SELECT near.post_id, (SELECT count(*) FROM favorites WHERE post_id = 3) AS fav_query, (SELECT count(*) FROM favorites f WHERE f.post_id = near.post_id) AS fav_candidate FROM near", NEAR3))
def q_fav_pair(s, d):
    near = similarity.similar_to(views.cf(s, d), 3, 6).select("post_id")
    fav = counts.fav_count(views.favorites(s, d))
    own = views.favorites(s, d).where("post_id = 3").agg(F.count("*").alias("fav_query"))
    return near.join(fav, "post_id", "left").crossJoin(F.broadcast(own)).select("post_id", "fav_query", F.coalesce("fav_count", F.lit(0)).alias("fav_candidate"))


# the ordered fold


@query()
def q_sgd_fold(s, d):
    rows = sgd.sgd_fold(scans.events_after(views.stream_events(s, d), -1, scans.EPOCH))
    return rows.select("kind", "id", F.round(C.norm(F.col("vec")), 6).alias("norm"))


@query(with_views("cf", f"SELECT post_id, round(sqrt({sql_dot('v', 'v')}), 6) AS norm_before, round(CASE WHEN sqrt({sql_dot('v', 'v')}) > 10 THEN 10.0 ELSE sqrt({sql_dot('v', 'v')}) END, 6) AS norm_after FROM (SELECT post_id, list_transform(vec, lambda t: t * (25 * (post_id % 2) + 1)) AS v FROM cf)"))
def q_clip_norm(s, d):
    rows = views.cf(s, d).select("post_id", F.transform(C.doubles(F.col("vec")), lambda x: x * (F.lit(25) * (F.col("post_id") % 2) + 1)).alias("v"))
    return rows.select("post_id", F.round(C.norm(F.col("v")), 6).alias("norm_before"), F.round(C.norm(C.clip_norm(F.col("v"), 10.0)), 6).alias("norm_after"))


@query(with_views("stream_events", "SELECT event_id, post_id, created_at - CASE WHEN event_id % 50 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END >= TIMESTAMP '2024-01-10' AS kept FROM stream_events WHERE event_id > 1000"))
def q_late_events(s, d):
    late = F.when(F.col("event_id") % 50 == 0, F.col("created_at") - F.expr("INTERVAL 10 DAYS")).otherwise(F.col("created_at"))
    return views.stream_events(s, d).where("event_id > 1000").select("event_id", "post_id", (late >= F.lit(datetime(2024, 1, 10))).alias("kept"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The posts most similar to post 3, in order, with score, counts and shared tags."""
    near = similarity.similar_to(views.cf(s, d), 3, 6)
    why = explain(s, d, 3, 6, 6).groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("shared_rank", "tag"))).alias("t"))
    return near.join(why, "post_id", "left").select("rank", "post_id", "score", F.coalesce(F.array_join(F.transform("t", lambda x: x["tag"]), ","), F.lit("")).alias("shared_tags"))
