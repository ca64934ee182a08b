"""The engine's relations as views over the driver's tables: posts, tags, favorites, events, vectors; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.columns import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tag_string, updated_at: a post for each part."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("size_"), F.col("p_size").cast("string")))
    changed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("updated_at"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("tag_string")).join(changed, "id", "left").select("id", "tag_string", "updated_at")


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tag_string of posts, for what needs no updated_at."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("size_"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("tag_string"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, category, post_count of the tags of posts; some are left out, so that unknown tags occur."""
    rows = part_tags(spark, sf_dir).select("id", F.posexplode(tokens(F.col("tag_string"))).alias("pos", "name"))
    origin = F.when(F.col("pos") == 0, 0).when(F.col("pos") == 1, 5).when(F.col("name").startswith("Brand#"), 1).when(F.col("name").startswith("size_"), 7).otherwise(3)
    own = F.when(F.col("name") == "Brand#25", 6).when(F.col("name") == "Brand#1", 4).when(F.col("name") == "PROMO", 8).when(F.col("name") == "ECONOMY", 2)
    # no post repeats a tag from one origin, so one pass counts posts; countDistinct guards against what does
    rows = rows.where(~F.col("name").isin("size_50", "size_49")).groupBy("name").agg(F.min(origin).alias("origin"), F.countDistinct("id").alias("post_count"))
    return rows.select("name", F.coalesce(own, F.col("origin")).cast("int").alias("category"), "post_count")


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_partkey").alias("post_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return lines.join(orders, "l_orderkey").select("user_id", "post_id").distinct()


def favorite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, post_id, action, created_at. Ids count up from 1 by ship date, then keys: ranked within each
    date, behind the counts of the dates before, so that no task ranks all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    dates = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"))
    before = dates.select("l_shipdate", F.coalesce(F.sum("n").over(Window.orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = lines.join(orders, "l_orderkey").withColumn("rank", rank).join(before, "l_shipdate")
    return rows.select((F.col("base") + F.col("rank")).cast("bigint").alias("event_id"), "user_id", F.col("l_partkey").alias("post_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("bigint").alias("action"), F.col("l_shipdate").alias("created_at"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("post_id"), F.when(F.col("event_type") == "error", -1).otherwise(1).cast("bigint").alias("action"), F.col("ts").alias("created_at"))


def doc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("tag_string"))


def cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("embedding").alias("vec"))


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, partner_id, vec, other: each vector with that of another post."""
    n = table(spark, sf_dir, "embeddings").count()  # from the footers
    rows = cf(spark, sf_dir).withColumn("partner_id", (F.col("post_id") * 7 + 1) % max(1, n))
    return rows.join(cf(spark, sf_dir).select(F.col("post_id").alias("partner_id"), F.col("vec").alias("other")), "partner_id").select("post_id", "partner_id", "vec", "other")


TAG_STRING = "p_name || ' ' || p_brand || ' ' || p_type || ' size_' || CAST(p_size AS VARCHAR)"
SPLIT = r"list_filter(regexp_split_to_array(coalesce(tag_string, ''), '[\s\x1c-\x1f\x85\p{Z}]+'), lambda x: x <> '')"
MULT = "CASE category WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 WHEN 3 THEN 1.5 WHEN 4 THEN 2.5 WHEN 5 THEN 2.0 WHEN 6 THEN 0.0 WHEN 7 THEN 0.5 WHEN 8 THEN 1.2 ELSE 1.0 END::DOUBLE"
SQL: dict[str, str] = {
    "posts": f"SELECT p_partkey AS id, {TAG_STRING} AS tag_string, m.updated_at FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1) m ON l_partkey = p_partkey",
    "tokens": f"SELECT id AS post_id, unnest(range(len({SPLIT}))) AS pos, unnest({SPLIT}) AS tag FROM posts",
    "tags": """SELECT tag AS name, CASE tag WHEN 'Brand#25' THEN 6 WHEN 'Brand#1' THEN 4 WHEN 'PROMO' THEN 8 WHEN 'ECONOMY' THEN 2 ELSE
      min(CASE WHEN pos = 0 THEN 0 WHEN pos = 1 THEN 5 WHEN tag LIKE 'Brand#%' THEN 1 WHEN tag LIKE 'size\\_%' ESCAPE '\\' THEN 7 ELSE 3 END) END AS category,
      count(DISTINCT post_id) AS post_count FROM tokens WHERE tag NOT IN ('size_50', 'size_49') GROUP BY tag""".replace("\\\\", "\\"),
    "favorites": "SELECT DISTINCT o_custkey AS user_id, l_partkey AS post_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'",
    "favorite_events": "SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id, o_custkey AS user_id, l_partkey AS post_id, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS action, l_shipdate AS created_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "stream_events": "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS post_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS action, ts AS created_at FROM events",
    "doc_posts": "SELECT doc_id AS id, text AS tag_string FROM documents",
    "cf": "SELECT vec_id AS post_id, embedding::DOUBLE[] AS vec FROM embeddings",
    "partners": "SELECT a.vec_id AS post_id, b.vec_id AS partner_id, a.embedding::DOUBLE[] AS vec, b.embedding::DOUBLE[] AS other FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)",
    "known": f"SELECT post_id, tag, coalesce(category, 0) AS category, count(*) AS n_occ, min(pos) AS first_pos, max({MULT}) AS mult, max({MULT} * (ln(((SELECT count(*) FROM posts) + 1.0::DOUBLE) / (coalesce(post_count, 1) + 1.0::DOUBLE)) + 1.0)) AS unit FROM (SELECT t.post_id, t.tag, t.pos, coalesce(g.category, 0) AS category, g.post_count FROM tokens t LEFT JOIN tags g ON g.name = t.tag) GROUP BY 1, 2, 3",
    "weights": "SELECT post_id, tag, category, n_occ, first_pos, unit * n_occ AS weight FROM known WHERE mult <> 0",
    "vocab": "SELECT row_number() OVER (ORDER BY m) - 1 AS tag_id, tag FROM (SELECT tag, min(struct_pack(p := post_id, f := first_pos)) AS m FROM weights GROUP BY tag)",
}
NEEDS = {"tokens": ["posts"], "tags": ["tokens"], "known": ["tokens", "tags", "posts"], "weights": ["known"], "vocab": ["weights"]}


def with_views(names: str, body: str, extra: str = "") -> str:
    """body behind the named views (and `extra` common table expressions) and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + ([extra] if extra else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body
