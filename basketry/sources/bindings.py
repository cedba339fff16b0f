"""Cart-model views over the order tables.

One SQL text per view, understood by Spark and by other ANSI engines. ``{name}`` stands for a
base table or another view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    # One menu item per part; the price spreads over all spending brackets.
    "b_items": """
        SELECT p.p_partkey AS item_id, p.p_name AS item_name, p.p_brand AS restaurant_id,
               CAST(CAST(p.p_retailprice * p.p_size / 50 AS DECIMAL(18,2)) AS DOUBLE) AS price,
               CASE WHEN p.p_type IN ('STANDARD', 'LARGE') THEN 'main' WHEN p.p_type = 'MEDIUM' THEN 'side'
                    WHEN p.p_type = 'SMALL' THEN 'beverage' WHEN p.p_type = 'ECONOMY' THEN 'dessert'
                    ELSE 'other' END AS item_category,
               CAST(coalesce(v.votes, 0) AS BIGINT) AS item_votes,
               CAST(CASE WHEN p.p_size >= 40 THEN 1 ELSE 0 END AS BIGINT) AS best_seller,
               CAST(p.p_size % 3 - 1 AS BIGINT) AS veg_flag
        FROM {part} p
        LEFT JOIN (SELECT l_partkey, count(*) AS votes FROM {lineitem} GROUP BY l_partkey) v
          ON v.l_partkey = p.p_partkey""",
    # Positive adds: a cart never holds an item twice.
    "b_adds": """
        SELECT session_id, item_id,
               CAST(row_number() OVER (PARTITION BY session_id ORDER BY line, item_id) - 1 AS BIGINT) AS step_number
        FROM (SELECT l_orderkey AS session_id, l_partkey AS item_id, min(l_linenumber) AS line
              FROM {lineitem} GROUP BY l_orderkey, l_partkey) x""",
    "b_sessions": """
        SELECT o.o_orderkey AS session_id, o.o_custkey AS user_id, o.o_orderdate AS ts,
               CAST(o.o_orderkey % 24 AS BIGINT) AS hour, n.n_name AS city,
               CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'budget' WHEN 'BUILDING' THEN 'premium'
                    WHEN 'MACHINERY' THEN 'luxury' ELSE 'moderate' END AS user_type
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "b_merchants": """
        SELECT p.p_brand AS restaurant_id, concat('Kitchen ', p.p_brand) AS restaurant_name, r.r_name AS city,
               CASE p.num % 7 WHEN 0 THEN 'North Indian' WHEN 1 THEN 'Chinese' WHEN 2 THEN 'Italian'
                    WHEN 3 THEN 'Fast Food' WHEN 4 THEN 'Healthy Food' WHEN 5 THEN 'Desserts' ELSE 'Nordic' END
                    AS cuisine,
               CAST(p.votes AS BIGINT) AS delivery_votes,
               CASE WHEN p.num % 9 = 0 THEN NULL
                    ELSE floor((3 + 20 * p.discount / p.votes) * 10000 + 0.5) / 10000 END AS delivery_rating
        FROM (SELECT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS num, count(*) AS votes,
                     CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount
              FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand) p
        JOIN {nation} n ON n.n_nationkey = (p.num - 1) % 25
        JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    "b_users": """
        SELECT c.c_custkey AS user_id, r.r_name AS city,
               CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'budget' WHEN 'BUILDING' THEN 'premium'
                    WHEN 'MACHINERY' THEN 'luxury' ELSE 'moderate' END AS user_type,
               CASE c.c_custkey % 4 WHEN 0 THEN 'indian' WHEN 1 THEN 'chinese|western'
                    WHEN 2 THEN 'fast_food|dessert|healthy' ELSE 'western' END AS preferred_cuisines,
               CAST(floor(abs(c.c_acctbal) / 10 * 100 + 0.5) / 100 AS DOUBLE) AS avg_order_value
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    # Item names with dish words, for the categorizer.
    "b_dishes": """
        SELECT p_partkey AS item_id, p_brand AS restaurant_id,
               CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat(split_part(p_name, ' ', 1), ' ',
                 CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'gulab jamun' WHEN 'widget' THEN 'chicken biryani'
                   WHEN 'bolt' THEN 'chocolate shake' WHEN 'rod' THEN 'garlic naan' WHEN 'gear' THEN 'paneer tikka'
                   WHEN 'plate' THEN 'butter chicken combo with naan' WHEN 'anvil' THEN 'veg roll'
                   ELSE 'house special' END) END AS item_name
        FROM {part}""",
    # Dirty menu export: one text row per order line, so restaurants and items repeat.
    "b_raw_menu": """
        SELECT CASE WHEN s.s_suppkey % 10 = 0 AND l.l_linenumber = 7 THEN ' ' ELSE concat('  ', s.s_name) END
                 AS restaurant_name,
               CASE s.s_suppkey % 6 WHEN 0 THEN 'NEW' WHEN 1 THEN '--' WHEN 2 THEN '4.25/5' WHEN 3 THEN NULL
                    WHEN 4 THEN '7.1' ELSE concat('3.', CAST(s.s_suppkey % 10 AS STRING)) END AS dining_rating,
               CASE s.s_suppkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(' 4.', CAST(s.s_suppkey % 10 AS STRING), ' ')
                    ELSE concat(CAST(2 + s.s_suppkey % 3 AS STRING), '.5') END AS delivery_rating,
               CASE l.l_partkey % 5 WHEN 0 THEN concat(CAST(l.l_partkey % 9 AS STRING), '.5K')
                    WHEN 1 THEN concat('1,', lpad(CAST(l.l_linenumber AS STRING), 3, '0')) WHEN 2 THEN 'new'
                    WHEN 3 THEN NULL ELSE CAST(l.l_partkey AS STRING) END AS dining_votes,
               CASE s.s_suppkey % 4 WHEN 0 THEN '1M' WHEN 1 THEN concat(CAST(s.s_suppkey AS STRING), ' votes')
                    WHEN 2 THEN '-' ELSE '2.5k' END AS delivery_votes,
               CASE s.s_suppkey % 7 WHEN 0 THEN 'Fastfood, Pizza' WHEN 1 THEN 'tex-mex' WHEN 2 THEN 'north indian, chinese'
                    WHEN 3 THEN NULL WHEN 4 THEN ' cafe' WHEN 5 THEN 'Desserts,Bakery' ELSE 'SOUTHINDIAN' END AS cuisine,
               CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE concat(' Area ', CAST(s.s_suppkey % 3 AS STRING)) END AS place,
               CASE s.s_nationkey % 6 WHEN 0 THEN ' bombay,' WHEN 1 THEN 'BLR' WHEN 2 THEN 'chef''s town'
                    WHEN 3 THEN NULL WHEN 4 THEN 'New Delhi' ELSE n.n_name END AS city,
               CASE WHEN l.l_partkey % 40 = 0 THEN ' .- ' ELSE concat('  "', p.p_name, '   Dish." ') END AS item_name,
               CASE p.p_size % 5 WHEN 0 THEN 'MUST TRY' WHEN 1 THEN '1' WHEN 2 THEN 'x' WHEN 3 THEN NULL
                    ELSE 'Chef''s Special' END AS best_seller,
               CAST(CAST(l.l_quantity AS INT) AS STRING) AS item_votes,
               CASE l.l_partkey % 6 WHEN 0 THEN concat('₹ 1,', lpad(CAST(p.p_size AS STRING), 3, '0'))
                    WHEN 1 THEN concat(CAST(p.p_size AS STRING), '-', CAST(p.p_size + 50 AS STRING))
                    WHEN 2 THEN 'free' WHEN 3 THEN concat('-', CAST(p.p_size AS STRING))
                    WHEN 4 THEN NULL ELSE CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS STRING) END AS price
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
        JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    # Item vectors, some of them zero as for items that were never walked.
    "b_vectors": """
        SELECT vec_id AS item_id, CAST(label AS STRING) AS item_category,
               CASE WHEN vec_id % 17 = 0 THEN transform(embedding, x -> CAST(0 AS DOUBLE))
                    ELSE transform(embedding, x -> CAST(x AS DOUBLE)) END AS vector
        FROM {embeddings}""",
}


class CartModel:
    """Lazily built views; each is a plan, nothing is computed here."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                inputs = {dep: self[dep] for dep in [*BASE_TABLES, *VIEWS] if "{" + dep + "}" in text}
                self._frames[name] = self.spark.sql(text, **inputs)
        return self._frames[name]

    def dealt_adds(self, tasks: int) -> DataFrame:
        """``b_adds`` of lines that move once, to their session in one of ``tasks`` tasks."""
        lines = self["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber").repartition(tasks, "l_orderkey")
        return self.spark.sql(VIEWS["b_adds"], lineitem=lines)
