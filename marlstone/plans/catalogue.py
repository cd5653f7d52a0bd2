"""Catalogue queries: listing, ranking, likes, details, daily picks, ingestion audits, sensory projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domain, search
from .relations import duckdb_sql, spark_sql

#: One text serves Spark and DuckDB where the dialects agree.
SHARED = {
    "explore_map": "SELECT id, name, AT(embedding, 1) AS x, AT(embedding, 2) AS y, AT(embedding, 3) AS z FROM @items WHERE embedding IS NOT NULL ORDER BY id",
    "point_lookup": "SELECT id, name, base_tag, glass, abv FROM @parts WHERE id = 42 LIMIT 1",
    "list_page": "SELECT id, name, base_tag, (SELECT count(*) FROM @parts WHERE base_tag = 'Brand#7') AS total, (SELECT count(*) FROM @parts WHERE base_tag = 'Brand#7') > 20 AS has_next FROM @parts WHERE base_tag = 'Brand#7' ORDER BY id LIMIT 10 OFFSET 10",
    "list_page_liked": "SELECT i.id, i.name, l.item_id IS NOT NULL AS is_liked FROM (SELECT id, name FROM @parts ORDER BY id LIMIT 100 OFFSET 200) i LEFT JOIN (SELECT item_id FROM @likes WHERE user_id = 7) l ON i.id = l.item_id",
    "fetch_ordered": "SELECT p.pos, i.id, i.name FROM (SELECT 0 AS pos, 77 AS id UNION ALL SELECT 1, 5 UNION ALL SELECT 2, 900000000 UNION ALL SELECT 3, 41) p JOIN @parts i ON i.id = p.id ORDER BY p.pos",
    "exists_check": "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM @parts WHERE id = 123 LIMIT 1) t",
    "descriptor_catalog": "SELECT glass, count(*) AS n_items, CAST(dense_rank() OVER (ORDER BY glass) AS BIGINT) AS display_order, 1 AS max_selections FROM @parts WHERE abv > 0 GROUP BY glass",
    "base_tags": "SELECT DISTINCT base_tag FROM @parts WHERE base_tag IS NOT NULL ORDER BY base_tag",
    "liked_list": "SELECT i.id, i.name, l.created_at FROM @likes l JOIN @parts i ON i.id = l.item_id WHERE l.user_id = 7 ORDER BY l.created_at DESC, i.id LIMIT 21",
    "first_n": "SELECT c_custkey AS id, c_name AS name FROM @customer ORDER BY c_custkey LIMIT 10",
    "like_ranking": "SELECT i.id, i.name, coalesce(l.n, 0) AS like_count FROM @parts i LEFT JOIN (SELECT item_id, count(*) AS n FROM @likes GROUP BY item_id) l ON i.id = l.item_id ORDER BY coalesce(l.n, 0) DESC, i.id LIMIT 20",
    "like_count": "SELECT count(*) AS like_count FROM @likes WHERE item_id = 42",
    "like_counts_for": "SELECT w.id, coalesce(l.n, 0) AS like_count FROM (SELECT id FROM @parts WHERE id < 100) w LEFT JOIN (SELECT item_id, count(*) AS n FROM @likes WHERE item_id < 100 GROUP BY item_id) l ON w.id = l.item_id",
    "detail_join": "SELECT b.cocktail_id, b.ingredient_id, i.name, i.glass AS category, b.amount, b.unit, (SELECT count(*) FROM @likes WHERE item_id = 42) AS like_count, (SELECT count(*) FROM @likes WHERE item_id = 42 AND user_id = 7) > 0 AS is_liked FROM @bridge b JOIN @parts i ON i.id = b.ingredient_id WHERE b.cocktail_id = 42",
    "recent_like_vectors": "SELECT r.user_id, r.item_id, r.recency, i.embedding FROM (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id) AS BIGINT) AS recency FROM @likes) r JOIN @items i ON i.id = r.item_id WHERE r.recency <= 5 AND i.embedding IS NOT NULL",
    "bipartite_edges": "SELECT b.cocktail_id, b.ingredient_id, round(ln(1 + greatest(b.amount * CASE b.unit WHEN 'A' THEN 1.0 WHEN 'N' THEN 30.0 ELSE 5.0 END, 0.1)), 9) AS weight FROM @bridge b JOIN @parts i ON i.id = b.ingredient_id",
    "daily_pick": "SELECT id, name FROM @parts ORDER BY md5(concat('2024-05-01', CAST(id AS STRING))), id LIMIT 5",
    "axis_category_counts": "SELECT glass AS category, count(*) AS n FROM @parts GROUP BY glass",
    "prompt_stats": "SELECT CAST(min(octet_length(name)) AS BIGINT) AS min_bytes, CAST(max(octet_length(name)) AS BIGINT) AS max_bytes, round(avg(octet_length(name)), 9) AS mean_bytes FROM @parts",
    "cohort_filter": "SELECT w.id FROM (SELECT id FROM @parts WHERE id < 700) w LEFT JOIN @v v ON v.id = w.id WHERE v.id IS NULL",
    "pending_batch": "SELECT i.id, i.name FROM @parts i LEFT JOIN (SELECT DISTINCT item_id FROM @likes WHERE created_at >= CAST('2001-06-01' AS TIMESTAMP)) l ON i.id = l.item_id WHERE i.id >= 100 AND l.item_id IS NULL",
    "selection_errors": "SELECT id, CASE WHEN n > 1 THEN 'duplicate' WHEN category IS NULL THEN 'unknown' ELSE 'more than one in the category' END AS problem FROM (SELECT id, n, category, count(*) OVER (PARTITION BY category) AS together FROM (SELECT s.id, count(*) AS n, max(i.glass) AS category FROM (SELECT 3 AS id UNION ALL SELECT 3 UNION ALL SELECT 8 UNION ALL SELECT 11 UNION ALL SELECT 17 UNION ALL SELECT 42 UNION ALL SELECT 99999999) s LEFT JOIN @parts i ON i.id = s.id GROUP BY s.id) g) t WHERE n > 1 OR category IS NULL OR together > 1",
    "id_set_diff": "SELECT id, count(*) AS n_sources FROM (SELECT id, 'items' AS src FROM @parts UNION SELECT item_id, 'likes' FROM @likes UNION SELECT id, 'vectors' FROM @v UNION SELECT ingredient_id, 'bridge' FROM @bridge) t GROUP BY id HAVING count(*) < 4",
    "shard_requests": "SELECT concat('r', lpad(CAST(r.n AS STRING), 4, '0'), '-a', lpad(CAST(a.axis AS STRING), 2, '0')) AS request_key, r.id, a.axis, a.axis % 8 AS shard FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM @parts) r CROSS JOIN (SELECT DISTINCT abv - 1 AS axis FROM @parts WHERE abv <= 48) a",
    "upsert_vectors": "SELECT i.id, i.name, coalesce(n.price, i.price) AS price, n.id IS NOT NULL AS updated FROM @parts i LEFT JOIN (SELECT id, price * 2 AS price FROM @parts WHERE id % 7 = 0) n ON n.id = i.id",
    "incremental_export": "SELECT count(*) AS total, count_if(e.id IS NOT NULL AND e.name = i.name) AS current_rows, count_if(e.id IS NOT NULL AND e.name <> i.name) AS invalid_rows, count_if(e.id IS NULL) AS pending_rows FROM @parts i LEFT JOIN (SELECT id, CASE WHEN id % 11 = 0 THEN 'old' ELSE name END AS name FROM @parts WHERE id % 3 = 0) e ON e.id = i.id",
    "like_toggle": "SELECT user_id, item_id, created_at FROM @likes WHERE NOT (user_id = 7 AND item_id % 2 = 0) UNION ALL SELECT 7 AS user_id, 123456 AS item_id, max(created_at) AS created_at FROM @likes",
    "prompt_lookup": "SELECT i.id, coalesce(t.prompt, 'other') AS prompt FROM @parts i LEFT JOIN (SELECT 'economy' AS glass, 'tall glass' AS prompt UNION ALL SELECT 'standard', 'short glass') t ON lower(trim(i.glass)) = t.glass",
    "verify_after_write": "SELECT count(*) AS n, count_if(embedding IS NULL) AS null_vectors, count_if(embedding IS NOT NULL AND AT(embedding, 64) IS NULL) AS short_vectors FROM @items",
    "nested_sources_flat": "SELECT i.id, count(b.ingredient_id) AS n_links, coalesce(round(sum(b.amount), 6), 0.0) AS amount FROM @parts i LEFT JOIN @bridge b ON b.cocktail_id = i.id GROUP BY i.id",
    "profile_rules": "SELECT id, abv, CASE WHEN abv < 5 AND base_tag = 'Brand#1' THEN 'low abv for base' WHEN abv > 45 AND glass = 'ECONOMY' THEN 'high abv for glass' END AS violation FROM @parts WHERE (abv < 5 AND base_tag = 'Brand#1') OR (abv > 45 AND glass = 'ECONOMY')",
    "descriptor_support": "SELECT base_tag AS code, count(*) AS support, count(embedding) AS with_vector FROM @items GROUP BY base_tag",
    "parse_summary": "SELECT count(*) AS n, count_if(props LIKE '%\"k\"%') AS accepted, count_if(props NOT LIKE '%\"k\"%') AS quarantined, count_if(props IS NULL) AS missing FROM @events",
    "manifest_audit": "SELECT count(*) - count(DISTINCT id) AS repeated_ids, count_if(id IS NULL) AS null_ids, count_if(name IS NULL OR name = '') AS unnamed, max(id) - min(id) + 1 - count(DISTINCT id) AS gaps FROM @parts",
    "contract_report": "SELECT count_if(y < prev) AS falls, round(max(y), 9) AS highest, round(max(abs(y / x - 1.2)), 9) AS ratio_error FROM (SELECT x, y, lag(y) OVER (ORDER BY x) AS prev FROM (SELECT (id + 1) / 1000.0 AS x, least(1.2 * (id + 1) / 1000.0, pi()) AS y FROM @parts) u) t",
    "response_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count_if(value IS NULL) AS missing FROM @events GROUP BY event_type",
    "name_tiers": "SELECT id, name, tier, score FROM (SELECT id, name, CASE WHEN q = t THEN 4 WHEN t LIKE concat(q, '%') THEN 3 WHEN t LIKE concat('%', q, '%') THEN 2 END AS tier, CASE WHEN q = t THEN 1.0 WHEN t LIKE concat('%', q, '%') THEN round(length(q) * 1.0 / length(t), 9) END AS score FROM (SELECT id, name, 'red' AS q, replace(lower(name), ' ', '') AS t FROM @parts) u) w WHERE tier IS NOT NULL ORDER BY tier DESC, score DESC, length(name), id LIMIT 20",
}

QUERIES = {name: spark_sql(text) for name, text in SHARED.items()}
ORACLES = {name: duckdb_sql(text).replace(" AS STRING)", " AS VARCHAR)").replace("octet_length(", "strlen(") for name, text in SHARED.items()}


def random_pick(spark: SparkSession, d: str) -> DataFrame:
    """Five rows at random, by a seed."""
    return domain.parts(spark, d).select("id", "name", F.lit(0.0).alias("similarity")).orderBy(F.rand(7)).limit(5)


def nested_sources(spark: SparkSession, d: str) -> DataFrame:
    """Items with their ingredients as a sorted array, empty where there are none."""
    links = domain.bridge(spark, d).groupBy(F.col("cocktail_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ingredient_id", "amount", "unit"))).alias("ingredients"))
    none = F.array().cast("array<struct<ingredient_id:bigint,amount:double,unit:string>>")
    return domain.parts(spark, d).select("id", "name").join(links, "id", "left").select("id", "name", F.coalesce("ingredients", none).alias("ingredients"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of name matches with their like counts and whether user 7 likes them, in the order of the search."""
    names = domain.parts(spark, d).groupBy("name").agg(F.min("id").alias("id")).select("id", "name", F.col("name").alias("name_en"))
    hits = search.search(names, "widget", 10, 2)
    likes = domain.likes(spark, d).join(F.broadcast(hits.select(F.col("id").alias("item_id"))), "item_id")
    counts = likes.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("like_count"), F.bool_or(F.col("user_id") == 7).alias("is_liked"))
    return hits.join(counts, "id", "left").fillna({"like_count": 0, "is_liked": False}).orderBy(F.desc("tier"), F.desc("score"), F.length("name"), "id")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct names that share a word, by Jaccard similarity of their words."""
    names = domain.parts(spark, d).select("name").distinct().withColumn("words", F.array_distinct(F.split("name", " ")))
    words = names.select("name", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = words.select(F.col("name").alias("other"), F.col("n").alias("m"), "word")
    shared = words.join(other, "word").where("name < other").groupBy("name", "other", "n", "m").agg(F.count("*").alias("both"))
    return shared.select("name", "other", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 9).alias("similarity"))


QUERIES |= {"search_page": search_page, "jaccard_pairs": jaccard_pairs}
ORACLES["jaccard_pairs"] = "SELECT a.name, b.name AS other, round(len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9)::DOUBLE AS similarity FROM (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name, ' ')) AS w FROM part) a JOIN (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name, ' ')) AS w FROM part) b ON a.name < b.name WHERE len(list_intersect(a.w, b.w)) > 0"
QUERIES |= {"random_pick": random_pick, "nested_sources": nested_sources}
