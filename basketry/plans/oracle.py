"""Independent SQL for the registered queries, for another engine on the same tables.

Each entry is a final SELECT over named building blocks; ``build`` prepends the blocks it needs.
"""

from __future__ import annotations

import re

from basketry import vocab
from basketry.functions.keywords import CLASSES, default_words
from basketry.sources.bindings import VIEWS

BLOCKS: dict[str, str] = {
    name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in VIEWS.items() if name != "b_vectors"
}
FINAL: dict[str, str] = {}


def r(x: str, n: int = 6) -> str:
    d = f"CAST(({x}) AS DOUBLE)"
    return f"(CASE WHEN abs({d}) * 1e{n} < 9007199254740992 THEN floor({d} * 1e{n} + 0.5) / 1e{n} ELSE {d} END)"


def xmean(x: str, scale: int = 4) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE) / nullif(count({x}), 0))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def strings(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def case(column: str, table: dict, default: str) -> str:
    def value(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


def build(final: str) -> str:
    """WITH clause of all blocks used, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(BLOCKS[name])
                if name not in order:
                    order.append(name)

    visit(final)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in order) + "\n" + final


def text_list(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


def vector_list(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(floor(v * 1e6 + 0.5) AS BIGINT)), ',')"


# ---- Blocks ------------------------------------------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TITLE = (
    "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[^a-z]+'), "
    "lambda w: upper(w[1]) || w[2:]), '')"
)
NUM = "TRY_CAST(regexp_extract({0}, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE)"


def s_strip(x):
    return STRIP.format(x)


def s_city(x):
    key = f"regexp_replace(lower({s_strip(x)}), '^[\\s,]+|[\\s,]+$', '', 'g')"
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' ELSE {case(key, vocab.CITY_ALIASES, TITLE.format(s_strip(x)))} END"


def s_cuisine(x):
    primary = s_strip(f"split_part({x}, ',', 1)")
    return f"CASE WHEN {x} IS NULL THEN 'Other' ELSE {case(f'lower({primary})', vocab.CUISINE_ALIASES, TITLE.format(primary))} END"


def s_rating(x):
    text = f"lower({s_strip(x)})"
    return (f"CASE WHEN {text} NOT IN {strings(vocab.RATING_MISSING)} AND {NUM.format(text)} BETWEEN 0 AND 5 "
            f"THEN {r(NUM.format(text), 2)} END")


def s_votes(x):
    text = f"lower({s_strip(x)})"
    compact = f"replace(replace({text}, ',', ''), ' ', '')"
    unit = f"CASE WHEN {compact} LIKE '%k' THEN 1e3 WHEN {compact} LIKE '%m' THEN 1e6 ELSE 1.0 END"
    return (f"CAST(coalesce(CASE WHEN {text} NOT IN {strings(vocab.VOTES_MISSING)} "
            f"THEN trunc({NUM.format(compact)} * CAST({unit} AS DOUBLE)) END, 0) AS BIGINT)")


def s_price(x):
    text = f"lower({s_strip(x)})"
    compact = f"regexp_replace({text}, '[₹$€£,\\s]', '', 'g')"
    low = f"CASE WHEN {compact} LIKE '-%' THEN {compact} ELSE split_part({compact}, '-', 1) END"
    return f"CASE WHEN {text} NOT IN {strings(vocab.PRICE_MISSING)} THEN {r(NUM.format(low), 2)} END"


def s_item_name(x):
    spaced = f"regexp_replace({s_strip(f'lower({x})')}, '\\s+', ' ', 'g')"
    return f"coalesce(trim({spaced}, '.-_,;:''\"'), '')"


def s_best(x):
    text = f"lower({s_strip(x)})"
    tags = " OR ".join(f"contains({text}, '" + t.replace("'", "''") + "')" for t in vocab.BESTSELLER_TAGS)
    return f"CAST(coalesce({tags} OR {text} IN {strings(vocab.BESTSELLER_FLAGS)}, FALSE) AS BIGINT)"


BLOCKS["o_text"] = f"""
    SELECT {s_strip('restaurant_name')} AS restaurant_name, {s_city('city')} AS city, {s_strip('place')} AS place,
           {s_cuisine('cuisine')} AS cuisine, {s_rating('delivery_rating')} AS delivery_rating,
           {s_votes('delivery_votes')} AS delivery_votes, {s_rating('dining_rating')} AS dining_rating,
           {s_votes('dining_votes')} AS dining_votes, {s_item_name('item_name')} AS item_name,
           {s_price('price')} AS price, {s_votes('item_votes')} AS item_votes, {s_best('best_seller')} AS best_seller
    FROM b_raw_menu"""
BLOCKS["o_merchant_rows"] = """
    SELECT *, 'REST_' || upper(substr(md5(concat_ws('|', lower(restaurant_name), lower(city), coalesce(lower(place), ''))), 1, 12))
           AS restaurant_id FROM o_text"""
BLOCKS["o_rows"] = """
    SELECT *, 'ITEM_' || upper(substr(md5(concat_ws('|', lower(restaurant_id), item_name,
           coalesce(CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), '0'))), 1, 12)) AS item_id FROM o_merchant_rows"""
BLOCKS["o_named"] = "SELECT * FROM o_rows WHERE length(restaurant_name) > 0"
BLOCKS["o_priced"] = "SELECT * FROM o_rows WHERE price > 0 AND length(item_name) > 0"
BLOCKS["o_unique"] = """
    SELECT restaurant_id, dining_votes, delivery_votes, delivery_rating, dining_rating, cuisine, city, restaurant_name
    FROM o_named QUALIFY row_number() OVER (PARTITION BY restaurant_id ORDER BY dining_votes DESC, delivery_votes DESC,
      delivery_rating DESC NULLS LAST, dining_rating DESC NULLS LAST, cuisine DESC, city DESC, restaurant_name DESC) = 1"""
BLOCKS["o_restaurants"] = """
    SELECT restaurant_id, dining_votes, delivery_votes,
           coalesce(delivery_rating, (SELECT quantile_cont(delivery_rating, 0.5) FROM o_unique)) AS delivery_rating,
           coalesce(dining_rating, (SELECT quantile_cont(dining_rating, 0.5) FROM o_unique)) AS dining_rating,
           cuisine, city, restaurant_name FROM o_unique"""
BLOCKS["o_menu"] = """
    SELECT item_id, item_votes, best_seller, price, item_name, restaurant_id
    FROM o_priced WHERE restaurant_id IN (SELECT restaurant_id FROM o_restaurants)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY item_votes DESC, best_seller DESC) = 1"""


def word_forms(name: str) -> list[str]:
    """Keywords of a class and their plurals, longest first, so that "garlic naan" wins over "naan"."""
    own = [word for kind, word in default_words() if kind == name]
    plural = [w + ("es" if re.search("(s|x|z|ch|sh)$", w) else "s") for w in own if not w.endswith("y")]
    return sorted({*own, *plural}, key=lambda w: (-len(w), w))


def hits(x: str, name: str) -> str:
    """Letters outside ASCII become "_", a word character for this engine's word boundary."""
    plain = f"regexp_replace(lower({x}), '[^\\x00-\\x7F\\PL]', '_', 'g')"
    words = "(" + "|".join(word_forms(name)) + ")"
    return f"list_distinct(regexp_extract_all({plain}, '\\b{words}\\b', 1))"


_partial = " ".join(
    f"WHEN contains(c, '{n}') THEN '{cat}'" for cat, names in vocab.CUISINE_CATEGORY.items() for n in names
)
_exact = " ".join(f"WHEN c IN {strings(names)} THEN '{cat}'" for cat, names in vocab.CUISINE_CATEGORY.items())
BLOCKS["o_cuisine_names"] = "SELECT cuisine FROM o_text UNION SELECT cuisine FROM b_merchants"
BLOCKS["o_cuisine_map"] = f"""
    SELECT cuisine, coalesce(CASE {_exact} END, CASE {_partial} END) AS category
    FROM (SELECT cuisine, trim(lower(cuisine)) AS c FROM o_cuisine_names)"""
BLOCKS["o_dish_hits"] = f"""
    SELECT d.item_id, d.restaurant_id, d.item_name, f.category AS by_cuisine,
           {', '.join(f"len({hits('d.item_name', c)}) AS {c}" for c in CLASSES)}
    FROM b_dishes d LEFT JOIN b_merchants m ON m.restaurant_id = d.restaurant_id
    LEFT JOIN o_cuisine_map f ON f.cuisine = m.cuisine"""
BLOCKS["o_dishes"] = """
    SELECT item_id, restaurant_id, item_name,
      CASE WHEN item_name = '' THEN 'main' WHEN beverage > 0 THEN 'beverage' WHEN dessert > 0 THEN 'dessert'
           WHEN side > 0 AND main > side THEN 'main' WHEN side > 0 THEN 'side' WHEN main > 0 THEN 'main'
           ELSE coalesce(by_cuisine, 'main') END AS item_category,
      CASE WHEN item_name = '' THEN 'default_fallback' WHEN beverage + dessert + side + main > 0 THEN 'keyword'
           WHEN by_cuisine IS NOT NULL THEN 'cuisine_fallback' ELSE 'default_fallback' END AS decision_source,
      CAST(CASE WHEN item_name = '' THEN 0.3 WHEN beverage > 0 THEN least(1.0, 0.7 + 0.1 * beverage)
           WHEN dessert > 0 THEN least(1.0, 0.7 + 0.1 * dessert)
           WHEN side > 0 AND main > side THEN least(1.0, 0.6 + 0.1 * main)
           WHEN side > 0 THEN least(1.0, 0.6 + 0.1 * side) WHEN main > 0 THEN least(1.0, 0.6 + 0.1 * main)
           WHEN by_cuisine IS NOT NULL THEN 0.5 ELSE 0.4 END AS DOUBLE) AS category_confidence,
      CAST(CASE WHEN non_veg > 0 THEN 0 WHEN veg > 0 THEN 1 ELSE -1 END AS BIGINT) AS veg_flag,
      CAST(CASE WHEN non_veg > 0 THEN least(1.0, 0.8 + 0.05 * non_veg) WHEN veg > 0 THEN least(1.0, 0.7 + 0.05 * veg)
           ELSE 0 END AS DOUBLE) AS veg_confidence
    FROM o_dish_hits"""
BLOCKS["o_smoothed"] = f"""
    SELECT *, {r('coalesce((delivery_rating * delivery_votes + mean * 50) / (delivery_votes + 50), mean)', 3)} AS smoothed_rating
    FROM b_merchants, (SELECT {xmean('delivery_rating')} AS mean FROM b_merchants)"""
BLOCKS["o_scored_menu"] = """
    SELECT *, vote_score * CAST(0.7 AS DOUBLE) + best_seller * CAST(0.3 AS DOUBLE) AS menu_score
    FROM (SELECT *, (item_votes - min(item_votes) OVER w) / (max(item_votes) OVER w - min(item_votes) OVER w + 1e-10)
                 AS vote_score FROM b_items WINDOW w AS (PARTITION BY restaurant_id))"""
BLOCKS["o_menu_rank"] = """
    SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY menu_score DESC, item_id) AS item_rank FROM o_scored_menu"""
BLOCKS["o_price_stats"] = f"""
    SELECT m.restaurant_id, coalesce(s.mean, (SELECT quantile_cont(mean, 0.5) FROM (
             SELECT {xmean('price')} AS mean FROM b_items WHERE restaurant_id IN (SELECT restaurant_id FROM b_merchants)
             GROUP BY restaurant_id))) AS avg_item_price,
           coalesce(s.std, 0) AS price_std, coalesce(s.n, 0) AS menu_size, m.delivery_votes, m.smoothed_rating
    FROM o_smoothed m LEFT JOIN (SELECT restaurant_id, {xmean('price')} AS mean, stddev_samp(price) AS std, count(*) AS n
      FROM b_items GROUP BY restaurant_id) s ON s.restaurant_id = m.restaurant_id"""
BLOCKS["o_banded"] = """
    SELECT *, CASE WHEN avg_item_price <= (SELECT quantile_cont(avg_item_price, 0.2) FROM o_price_stats) THEN 0
                   WHEN avg_item_price <= (SELECT quantile_cont(avg_item_price, 0.4) FROM o_price_stats) THEN 1
                   WHEN avg_item_price <= (SELECT quantile_cont(avg_item_price, 0.6) FROM o_price_stats) THEN 2
                   WHEN avg_item_price <= (SELECT quantile_cont(avg_item_price, 0.8) FROM o_price_stats) THEN 3 ELSE 4 END
           AS price_band_index FROM o_price_stats"""
BLOCKS["o_adds"] = "SELECT a.*, i.item_name, i.item_category, i.price, i.restaurant_id FROM b_adds a JOIN b_items i USING (item_id)"
BLOCKS["o_state"] = """
    SELECT *, coalesce(list(item_id) OVER w, []) AS cart_items, coalesce(list(item_category) OVER w, []) AS cart_categories,
           coalesce(CAST(sum(CAST(price AS DECIMAL(18,2))) OVER w AS DOUBLE), 0) AS cart_total
    FROM o_adds WINDOW w AS (PARTITION BY session_id ORDER BY step_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
MEAL = ("CASE WHEN hour BETWEEN 7 AND 10 THEN 'breakfast' WHEN hour BETWEEN 11 AND 14 THEN 'lunch' "
        "WHEN hour BETWEEN 15 AND 17 THEN 'snack' WHEN hour BETWEEN 18 AND 22 THEN 'dinner' ELSE 'late_night' END")
BLOCKS["o_steps"] = f"""
    SELECT s.*, x.user_id, x.ts, x.hour, x.city, x.user_type, {MEAL} AS meal_type
    FROM o_state s JOIN b_sessions x USING (session_id)"""
BLOCKS["o_pool"] = """
    SELECT restaurant_id, item_id, ln(1 + (item_votes + 1)) AS weight,
           ('0x' || substr(md5('0|' || item_id), 1, 7))::BIGINT + 1 AS mult,
           ('0x' || substr(md5('0|' || item_id), 8, 7))::BIGINT AS off
    FROM o_menu_rank WHERE item_rank <= 120"""
BLOCKS["o_negatives"] = """
    SELECT s.session_id, s.step_number, p.item_id,
           row_number() OVER (PARTITION BY s.session_id, s.step_number ORDER BY
             -ln((((p.mult * s.k + p.off) % 2147483647) + 1) / 2147483648.0::DOUBLE) / p.weight, p.item_id) AS pick
    FROM (SELECT *, ('0x' || substr(md5('0|' || session_id || '|' || step_number), 1, 7))::BIGINT AS k FROM o_state) s
    JOIN o_pool p ON p.restaurant_id = s.restaurant_id
    WHERE p.item_id <> s.item_id AND NOT list_contains(s.cart_items, p.item_id) QUALIFY pick <= 5"""
BLOCKS["o_events"] = """
    SELECT * EXCLUDE (item_id, item_name, item_category, price), item_id AS candidate_item, 1 AS label FROM o_steps
    UNION ALL
    SELECT s.* EXCLUDE (item_id, item_name, item_category, price), n.item_id, 0 FROM o_steps s
    JOIN o_negatives n ON n.session_id = s.session_id AND n.step_number = s.step_number"""


def pairs(item: str) -> str:
    return (f"SELECT a.session_id, a.{item} AS src, b.{item} AS dst FROM o_adds a JOIN o_adds b "
            f"ON a.session_id = b.session_id AND a.step_number < b.step_number AND a.{item} <> b.{item}")


for _name, _item in (("part", "item_id"), ("dense", "item_name")):
    BLOCKS[f"o_{_name}_pairs"] = pairs(_item)
    BLOCKS[f"o_{_name}_counts"] = f"SELECT src, dst, count(*) AS pair_count FROM o_{_name}_pairs GROUP BY ALL"
    BLOCKS[f"o_{_name}_nodes"] = f"SELECT {_item} AS item_id, count(*) AS n FROM o_adds GROUP BY ALL"
    BLOCKS[f"o_{_name}_edges"] = f"""
        SELECT src, dst, pair_count, n AS src_count, pair_count / n::DOUBLE AS prob,
               row_number() OVER (PARTITION BY src ORDER BY pair_count DESC, dst) AS rank
        FROM o_{_name}_counts JOIN o_{_name}_nodes ON item_id = src WHERE pair_count >= 2 QUALIFY rank <= 50"""
BLOCKS["o_sym"] = """
    SELECT src, dst, max(prob) AS weight FROM (SELECT src, dst, prob FROM o_dense_edges
    UNION ALL SELECT dst, src, prob FROM o_dense_edges) GROUP BY src, dst"""
BLOCKS["o_degree"] = """
    SELECT item_id, coalesce(degree, 0) AS degree FROM o_part_nodes
    LEFT JOIN (SELECT src, count(*) AS degree FROM o_part_edges GROUP BY src) ON src = item_id"""
BLOCKS["o_popular"] = """
    SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY item_votes DESC, item_id) AS popularity_rank FROM b_items"""
BLOCKS["b_vectors"] = """
    SELECT vec_id AS item_id, CAST(label AS VARCHAR) AS item_category,
           list_transform(embedding, lambda x: CASE WHEN vec_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(x AS DOUBLE) END) AS vector
    FROM embeddings"""
BLOCKS["o_index"] = """
    SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM b_vectors
    WHERE item_id IN (SELECT item_id FROM b_items)"""
BLOCKS["o_norm_votes"] = """
    SELECT *, CASE WHEN max(item_votes) OVER w > 0 THEN item_votes / max(item_votes) OVER w::DOUBLE
                   ELSE 1.0 / count(*) OVER w END AS norm_votes
    FROM {0} WINDOW w AS (PARTITION BY restaurant_id)""".replace("{0}", "o_capped")
BLOCKS["o_capped"] = "SELECT * FROM o_menu_rank WHERE item_rank <= 120"
_age = "floor((epoch(TIMESTAMP '2001-08-02') - epoch(max(ts))) / 86400)"
BLOCKS["o_users"] = f"""
    SELECT u.user_id, CAST(greatest(0, least(365, age)) AS BIGINT) AS recency_days,
      CAST(greatest(1, least(1000, frequency)) AS BIGINT) AS frequency,
      greatest(0.0, least(10000.0, {r('spend / steps', 2)})) AS monetary_avg,
      coalesce({r("least(len(string_split(p.preferred_cuisines, '|')), 5) / 5.0", 4)}, 0.5) AS cuisine_entropy,
      greatest(0.0, least(20.0, {r('steps / frequency::DOUBLE', 2)})) AS avg_cart_size,
      {r('desserts / greatest(seen, 1)::DOUBLE', 4)} AS dessert_ratio,
      {r('beverages / greatest(seen, 1)::DOUBLE', 4)} AS beverage_ratio
    FROM (SELECT user_id, {_age} AS age, count(DISTINCT session_id) AS frequency, count(*) AS steps,
            CAST(sum(CAST(cart_total AS DECIMAL(18,2))) AS DOUBLE) AS spend, sum(len(cart_categories)) AS seen,
            sum(len(list_filter(cart_categories, lambda c: c = 'dessert'))) AS desserts,
            sum(len(list_filter(cart_categories, lambda c: c = 'beverage'))) AS beverages
          FROM o_steps GROUP BY user_id) u LEFT JOIN b_users p ON p.user_id = u.user_id"""
BLOCKS["o_merchants"] = """
    SELECT restaurant_id, greatest(1.0, least(5.0, smoothed_rating)) AS smoothed_rating,
      CAST(greatest(0, least(100000, delivery_votes)) AS BIGINT) AS delivery_votes,
      greatest(0.0, least(5000.0, avg_item_price)) AS avg_item_price, price_band_index,
      CAST(greatest(0, least(500, menu_size)) AS BIGINT) AS menu_size FROM o_banded"""


def fitted(table: str, source: str, feature: str) -> str:
    x = f"ln(1 + CAST({feature} AS DOUBLE))"
    return (f"SELECT '{table}' AS table_name, '{feature}' AS feature, 'log1p_zscore' AS transform, avg({x}) AS p1, "
            f"CASE WHEN stddev_samp({x}) > 0 THEN stddev_samp({x}) ELSE 1.0 END AS p2 FROM {source}")


BLOCKS["o_scalers"] = " UNION ALL ".join(
    [fitted("user", "o_users", f) for f in ("recency_days", "frequency", "monetary_avg", "avg_cart_size")]
    + [fitted("restaurant", "o_merchants", f) for f in ("delivery_votes", "avg_item_price", "menu_size")]
    + [f"SELECT 'user', '{f}', 'passthrough', NULL, NULL" for f in ("cuisine_entropy", "dessert_ratio", "beverage_ratio")]
    + ["SELECT 'restaurant', 'smoothed_rating', 'minmax', 3.0, 5.0", "SELECT 'restaurant', 'price_band_index', 'divide', 4.0, NULL"]
)


def z(feature: str, table: str) -> str:
    where = f"FROM o_scalers WHERE table_name = '{table}' AND feature = '{feature}'"
    return f"(ln(1 + {feature}) - (SELECT p1 {where})) / (SELECT p2 {where}) AS {feature}_norm"


BLOCKS["o_user_norm"] = f"""
    SELECT *, {z('recency_days', 'user')}, {z('frequency', 'user')}, {z('monetary_avg', 'user')},
      cuisine_entropy AS cuisine_entropy_norm, {z('avg_cart_size', 'user')}, dessert_ratio AS dessert_ratio_norm,
      beverage_ratio AS beverage_ratio_norm FROM o_users"""
BLOCKS["o_merchant_norm"] = f"""
    SELECT *, (smoothed_rating - 3.0) / 2.0 AS smoothed_rating_norm, {z('delivery_votes', 'restaurant')},
      {z('avg_item_price', 'restaurant')}, price_band_index / 4.0 AS price_band_index_norm,
      {z('menu_size', 'restaurant')} FROM o_merchants"""
CATEGORY = case("item_category", vocab.CATEGORY_INDEX, "7")
BLOCKS["o_item_features"] = f"""
    SELECT i.item_id, restaurant_id, coalesce(x.idx, -1) AS embedding_idx, {r('price', 2)} AS price,
      {r('(price - mean) / greatest(std, 1.0)', 4)} AS normalized_price, best_seller, CAST({CATEGORY} AS BIGINT) AS category_index,
      veg_flag FROM b_items i LEFT JOIN o_index x ON x.item_id = i.item_id,
      (SELECT {xmean('price')} AS mean, stddev_samp(price) AS std FROM b_items)"""
MAINS, SIDES = ("len(list_filter(cart_categories, lambda c: c = '%s'))" % n for n in ("main", "side"))
HEAVY = f"CAST({MAINS} >= 2 OR ({MAINS} >= 1 AND {SIDES} >= 1) AS BIGINT)"
HEAVY_SIZE = f"CAST({MAINS} >= 2 OR len(cart_items) >= 4 AS BIGINT)"
NO_BEV, NO_DES = (f"CAST(NOT list_contains(cart_categories, '{n}') AS BIGINT)" for n in ("beverage", "dessert"))
MEAL_IDX = case("meal_type", vocab.MEAL_TYPE_INDEX, "1")
USER_IDX = case("user_type", vocab.USER_TYPE_INDEX, "1")
BLOCKS["o_cart_lines"] = """
    SELECT session_id, step_number, unnest(cart_items) AS cart_item,
           unnest(range(len(cart_items))) AS position FROM o_state"""
BLOCKS["o_cart_idx"] = """
    SELECT session_id, step_number, list(idx ORDER BY position) AS idxs
    FROM o_cart_lines JOIN o_index ON item_id = cart_item GROUP BY session_id, step_number"""
BLOCKS["o_training"] = f"""
    SELECT e.session_id, e.step_number, user_id, e.restaurant_id, candidate_item, label, hour,
      CAST({MEAL_IDX} AS BIGINT) AS meal_type_idx, CAST({USER_IDX} AS BIGINT) AS user_type_idx, x.idx AS embedding_idx,
      len(cart_items) AS cart_size, cart_total AS cart_value, {NO_BEV} AS missing_beverage, {NO_DES} AS missing_dessert,
      {HEAVY_SIZE} AS heavy_meal, coalesce(c.idxs, []) AS cart_embedding_indices
    FROM o_events e JOIN o_index x ON x.item_id = e.candidate_item
    LEFT JOIN o_cart_idx c ON c.session_id = e.session_id AND c.step_number = e.step_number"""
BLOCKS["o_known_vectors"] = "SELECT * FROM b_vectors WHERE len(list_filter(vector, lambda x: x <> 0)) > 0"
BLOCKS["o_vector_cells"] = "SELECT item_category, unnest(vector) AS x, unnest(range(len(vector))) AS i FROM o_known_vectors"
BLOCKS["o_centroids"] = """
    SELECT item_category, list(x ORDER BY i) AS centroid FROM (
      SELECT item_category, i, avg(x) AS x FROM o_vector_cells GROUP BY item_category, i) GROUP BY item_category
    UNION ALL
    SELECT NULL, list(x ORDER BY i) FROM (SELECT i, avg(x) AS x FROM o_vector_cells GROUP BY i)"""
BLOCKS["o_filled"] = """
    SELECT v.item_id, v.item_category, len(list_filter(vector, lambda x: x <> 0)) = 0 AS was_zero,
      CASE WHEN len(list_filter(vector, lambda x: x <> 0)) = 0
           THEN coalesce(c.centroid, (SELECT centroid FROM o_centroids WHERE item_category IS NULL)) ELSE vector END AS raw
    FROM b_vectors v LEFT JOIN o_centroids c ON c.item_category = v.item_category"""
BLOCKS["o_unit"] = """
    SELECT item_id, item_category, was_zero,
      list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS vector FROM o_filled"""
BLOCKS["o_cart_cells"] = """
    SELECT session_id, step_number, unnest(vector) AS x, unnest(range(64)) AS i
    FROM o_cart_lines JOIN o_unit ON item_id = cart_item WHERE position < 10"""
BLOCKS["o_cart_means"] = """
    SELECT session_id, step_number, list(x ORDER BY i) AS cart_vector FROM (
      SELECT session_id, step_number, i, avg(x) AS x FROM o_cart_cells GROUP BY session_id, step_number, i)
    GROUP BY session_id, step_number"""
BLOCKS["o_cart_vector"] = """
    SELECT a.session_id, a.step_number, a.item_id, coalesce(c.cart_vector, list_transform(range(64), lambda x: CAST(0 AS DOUBLE))) AS cart_vector
    FROM b_adds a LEFT JOIN o_cart_means c ON c.session_id = a.session_id AND c.step_number = a.step_number"""
BLOCKS["o_policies"] = f"""
    SELECT e.session_id, e.step_number, candidate_item, label, 'heuristic' AS policy,
           CAST({NO_BEV} * CAST(p.item_category = 'beverage' AS BIGINT) AS DOUBLE) AS score
    FROM o_events e JOIN o_popular p ON p.item_id = candidate_item
    UNION ALL
    SELECT e.session_id, e.step_number, candidate_item, label, 'popularity', CAST(-popularity_rank AS DOUBLE)
    FROM o_events e JOIN o_popular p ON p.item_id = candidate_item
    UNION ALL
    SELECT session_id, step_number, candidate_item, label, 'random',
           (('0x' || substr(md5('42|' || session_id || '|' || step_number || '|' || candidate_item), 1, 7))::BIGINT + 0.5::DOUBLE)
             / 268435456.0::DOUBLE FROM o_events"""
BLOCKS["o_ranked"] = """
    SELECT *, row_number() OVER (PARTITION BY policy, session_id, step_number ORDER BY score DESC, candidate_item) AS rank
    FROM o_policies"""
BLOCKS["o_popular_ranked"] = "SELECT * FROM o_ranked WHERE policy = 'popularity'"


def step_metrics(k: int) -> str:
    dcg = f"sum(CASE WHEN rank <= {k} THEN label / log2(rank + 1) ELSE 0 END)"
    ideal = f"sum(CASE WHEN ideal <= {k} THEN label / log2(ideal + 1) ELSE 0 END)"
    top = f"sum(CASE WHEN rank <= {k} THEN label ELSE 0 END)"
    return (f"{top} / {k}.0::DOUBLE AS precision_{k}, coalesce({top} / nullif(sum(label), 0)::DOUBLE, 0) AS recall_{k}, "
            f"coalesce({dcg} / nullif({ideal}, 0), 0) AS ndcg_{k}, CAST({top} > 0 AS DOUBLE) AS acceptance_{k}")


KS = (1, 3, 5, 8)
METRICS = [f"{m}_{k}" for k in KS for m in ("precision", "recall", "ndcg", "acceptance")] + ["mrr"]
BLOCKS["o_step_metrics"] = f"""
    SELECT policy, session_id, step_number, {', '.join(step_metrics(k) for k in KS)},
           coalesce(1.0::DOUBLE / min(CASE WHEN label = 1 THEN rank END), 0) AS mrr
    FROM (SELECT *, row_number() OVER (PARTITION BY policy, session_id, step_number ORDER BY label DESC) AS ideal FROM o_ranked)
    GROUP BY policy, session_id, step_number"""
BLOCKS["o_means"] = " UNION ALL ".join(
    f"SELECT policy, '{m}' AS metric, avg({m}) AS value FROM o_step_metrics GROUP BY policy" for m in METRICS
)
BLOCKS["o_accepted"] = """
    SELECT policy, session_id, step_number, count(*) FILTER (WHERE rank <= 3 AND label = 1) AS accepted,
      coalesce(CAST(sum(CAST(price AS DECIMAL(18,2))) FILTER (WHERE rank <= 3 AND label = 1) AS DOUBLE), 0) AS value,
      coalesce(min(rank) FILTER (WHERE rank <= 3 AND label = 1), -1) AS first_position
    FROM o_ranked JOIN b_items ON item_id = candidate_item GROUP BY policy, session_id, step_number"""
BLOCKS["o_policy_metrics"] = """
    SELECT policy, count(*) AS steps, avg(CAST(accepted > 0 AS DOUBLE)) AS attach_rate,
      sum(accepted) / count(*) FILTER (WHERE accepted > 0)::DOUBLE AS addons_per_accepting,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / sum(accepted) AS avg_addon_price,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS revenue_per_step,
      sum(accepted) / count(*)::DOUBLE AS items_per_step, avg(first_position) FILTER (WHERE accepted > 0) AS avg_position
    FROM o_accepted GROUP BY policy"""
BLOCKS["o_score_counts"] = """
    SELECT policy, score, sum(label) AS pos, sum(1 - label) AS neg FROM o_policies GROUP BY policy, score"""

# ---- Finals ------------------------------------------------------------------------------------

for _key, _column, _expr in (
    ("clean_city", "city", s_city), ("clean_cuisine", "cuisine", s_cuisine), ("clean_rating", "dining_rating", s_rating),
    ("clean_votes", "dining_votes", s_votes), ("clean_price", "price", s_price), ("clean_item_name", "item_name", s_item_name),
    ("clean_bestseller", "best_seller", s_best),
):
    FINAL[_key] = f"SELECT {_column} AS raw, {_expr(_column)} AS cleaned, count(*) AS n FROM b_raw_menu GROUP BY 1, 2"

FINAL |= {
    "merchant_key": "SELECT restaurant_id, restaurant_name, city, place, count(*) AS n FROM o_named GROUP BY ALL",
    "item_key": "SELECT item_id, restaurant_id, item_name, price, count(*) AS n FROM o_priced GROUP BY ALL",
    "scan_pruned": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL",
    "filter_named": "SELECT restaurant_name, count(*) AS n FROM o_named GROUP BY ALL",
    "filter_priced": "SELECT item_name, price, count(*) AS n FROM o_priced GROUP BY ALL",
    "filter_category": "SELECT item_id, restaurant_id, price FROM b_items WHERE item_category = 'dessert'",
    "dedupe_merchants": "SELECT * FROM o_unique",
    "impute_median": f"SELECT * REPLACE ({r('delivery_rating')} AS delivery_rating, {r('dining_rating')} AS dining_rating) FROM o_restaurants",
    "join_known_merchant": """SELECT restaurant_id, count(*) AS n FROM o_priced
        WHERE restaurant_id IN (SELECT restaurant_id FROM o_restaurants) GROUP BY ALL""",
    "dedupe_items": "SELECT * FROM o_menu",
    "category_index": f"SELECT item_category, CAST({CATEGORY} AS BIGINT) AS category_index, count(*) AS n FROM b_items GROUP BY ALL",
    "meal_type": f"SELECT hour, {MEAL} AS meal_type, count(*) AS n FROM b_sessions GROUP BY ALL",
    "context_encode": f"""SELECT {r('hour / 24.0')} AS hour_norm, CAST({MEAL_IDX} AS DOUBLE) AS meal_type_idx,
        CAST({USER_IDX} AS DOUBLE) AS user_type_idx, {', '.join(f"CAST(item_category = '{c}' AS DOUBLE) AS is_{c}" for c in
        ('main', 'dessert', 'beverage', 'side'))}, count(*) AS n FROM o_steps GROUP BY ALL""",
    "keyword_matches": "SELECT kind, id, " + ", ".join(
        f"{text_list('list_sort(' + hits('text', c) + ')')} AS {c}" for c in CLASSES
    ) + """ FROM (SELECT 'dish' AS kind, item_id AS id, item_name AS text FROM b_dishes
        UNION ALL SELECT 'text', doc_id, text FROM documents)""",
    "categorize_items": "SELECT item_id, item_category, decision_source FROM o_dishes",
    "category_confidence": f"SELECT item_id, item_category, {r('category_confidence')} AS category_confidence FROM o_dishes",
    "cuisine_fallback": """SELECT x.cuisine, category, n FROM (SELECT cuisine, count(*) AS n FROM o_text GROUP BY ALL
        UNION ALL SELECT cuisine, count(*) FROM b_merchants GROUP BY ALL) x JOIN o_cuisine_map m ON m.cuisine = x.cuisine""",
    "veg_status": f"SELECT item_id, veg_flag, {r('veg_confidence')} AS veg_confidence FROM o_dishes",
    "join_cuisine": "SELECT item_id, d.restaurant_id, cuisine FROM b_dishes d LEFT JOIN b_merchants m ON m.restaurant_id = d.restaurant_id",
    "enrich_menu": f"""SELECT item_id, restaurant_id, item_name, item_category, veg_flag, {r('category_confidence')} AS category_confidence,
        {r('veg_confidence')} AS veg_confidence FROM o_dishes""",
    "fallback_stats": """SELECT 'total' AS stat, count(*) AS n FROM o_dishes
        UNION ALL SELECT 'rule_based', count(*) FROM o_dishes WHERE category_confidence >= 0.5
        UNION ALL SELECT 'cuisine_fallback', count(*) FROM o_dishes WHERE decision_source = 'cuisine_fallback'
        UNION ALL SELECT 'default_fallback', count(*) FROM o_dishes WHERE decision_source = 'default_fallback'
        UNION ALL SELECT 'low_confidence', count(*) FROM o_dishes WHERE category_confidence < 0.5""",
    "smoothed_rating": "SELECT restaurant_id, delivery_rating, delivery_votes, smoothed_rating FROM o_smoothed",
    "smoothing_impact": f"""SELECT count(*) AS restaurants, {', '.join(
        f"{r(f'{fn}({c})')} AS {a}_{lab}" for c, lab in (('delivery_rating', 'raw'), ('smoothed_rating', 'smoothed'))
        for fn, a in (('min', 'min'), ('max', 'max'), ('avg', 'mean'), ('stddev_samp', 'std')))},
        {r('avg(abs(smoothed_rating - delivery_rating))')} AS mean_change, {r('max(abs(smoothed_rating - delivery_rating))')} AS max_change,
        count(*) FILTER (WHERE abs(smoothed_rating - delivery_rating) > 0.1) AS changed_over_0_1,
        count(*) FILTER (WHERE delivery_votes = 0) AS votes_none, count(*) FILTER (WHERE delivery_votes BETWEEN 1 AND 20) AS votes_low,
        count(*) FILTER (WHERE delivery_votes > 100) AS votes_high,
        {r('quantile_cont(delivery_rating, 0.5)')} AS median_raw, {r('quantile_cont(smoothed_rating, 0.5)')} AS median_smoothed
        FROM o_smoothed""",
    "vote_minmax": f"SELECT item_id, restaurant_id, {r('vote_score')} AS vote_score FROM o_scored_menu",
    "votes_norm_max": f"""SELECT item_id, restaurant_id, {r('''CASE WHEN max(item_votes) OVER w > 0
        THEN item_votes / max(item_votes) OVER w::DOUBLE ELSE 1.0 / count(*) OVER w END''')} AS norm_votes
        FROM b_items WINDOW w AS (PARTITION BY restaurant_id)""",
    "menu_rank": f"SELECT item_id, restaurant_id, {r('menu_score')} AS menu_score, item_rank FROM o_menu_rank",
    "cap_menu": "SELECT item_id, restaurant_id, item_rank FROM o_menu_rank WHERE item_rank <= 50",
    "capping_summary": f"""SELECT item_category, count(*) AS items_before, count(*) FILTER (WHERE item_rank <= 50) AS items_after,
        {r('100.0 * count(*) / (SELECT count(*) FROM b_items)')} AS pct_before,
        {r('100.0 * count(*) FILTER (WHERE item_rank <= 50) / (SELECT count(*) FROM o_menu_rank WHERE item_rank <= 50)')} AS pct_after,
        (SELECT count(DISTINCT restaurant_id) FROM o_menu_rank WHERE item_rank > 50) AS restaurants_affected,
        (SELECT count(*) FROM o_menu_rank WHERE item_rank > 50) AS items_removed FROM o_menu_rank GROUP BY item_category""",
    "merchant_price_stats": f"""SELECT restaurant_id, {r('avg_item_price')} AS avg_item_price, {r('price_std')} AS price_std,
        menu_size FROM o_price_stats""",
    "price_band": f"SELECT restaurant_id, {r('avg_item_price')} AS avg_item_price, {big('price_band_index')} AS price_band_index FROM o_banded",
    "menu_listing": """SELECT restaurant_id, popularity_rank AS position, item_id, item_name, price, item_category AS category,
        total FROM o_popular JOIN (SELECT restaurant_id, count(*) AS total FROM b_items GROUP BY 1) USING (restaurant_id)
        WHERE popularity_rank <= 20""",
    "recommend_popular": "SELECT restaurant_id, popularity_rank AS rank, item_id, item_votes FROM o_popular WHERE popularity_rank <= 8",
    "integrity_anti_joins": """SELECT 'integrity' AS section, 'orphan_menus' AS metric, CAST(count(*) AS DOUBLE) AS value FROM (
          SELECT DISTINCT restaurant_id FROM o_priced WHERE restaurant_id NOT IN (SELECT restaurant_id FROM o_named))
        UNION ALL SELECT 'integrity', 'restaurants_without_menu', CAST(count(*) AS DOUBLE) FROM (
          SELECT DISTINCT restaurant_id FROM o_named WHERE restaurant_id NOT IN (SELECT restaurant_id FROM o_priced))""",
    "id_set_diff": """SELECT restaurant_id, 'menu_only' AS side FROM (SELECT restaurant_id FROM o_priced EXCEPT SELECT restaurant_id FROM o_named)
        UNION ALL SELECT restaurant_id, 'restaurant_only' FROM (SELECT restaurant_id FROM o_named EXCEPT SELECT restaurant_id FROM o_priced)""",
    "filter_positive": "SELECT candidate_item, count(*) AS n FROM o_events WHERE label = 1 GROUP BY ALL",
    "ordered_sequence": f"SELECT session_id, {text_list('list(item_id ORDER BY step_number)')} AS item_sequence FROM b_adds GROUP BY session_id",
    "sequence_length_distribution": f"""SELECT length, count(*) AS sequences, {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct
        FROM (SELECT count(*) AS length FROM b_adds GROUP BY session_id) GROUP BY length""",
    "cart_size_distribution": f"""SELECT cart_size, count(*) AS sessions, {r('100.0 * count(*) / (SELECT count(DISTINCT session_id) FROM b_adds)')} AS pct,
        min(lo) AS min_size, {r('min(med)')} AS median_size, {r('min(mean)')} AS mean_size, min(hi) AS max_size
        FROM (SELECT *, min(cart_size) OVER () AS lo, max(cart_size) OVER () AS hi, avg(cart_size) OVER () AS mean,
          quantile_cont(cart_size, 0.5) OVER () AS med
        FROM (SELECT max(step_number) + 1 AS cart_size FROM b_adds GROUP BY session_id)) GROUP BY cart_size""",
    "step_state": f"""SELECT session_id, step_number, item_id, {text_list('cart_items')} AS cart_items,
        {text_list('cart_categories')} AS cart_categories, {r('cart_total')} AS cart_total FROM o_state""",
    "gap_predicate": """SELECT session_id, step_number, item_id FROM o_state
        WHERE list_contains(cart_categories, 'main') AND NOT list_contains(cart_categories, 'beverage')""",
    "self_join_pairs": "SELECT session_id, count(*) AS n FROM o_part_pairs GROUP BY session_id",
    "item_counts": "SELECT item_id, n FROM o_part_nodes",
    "pair_counts": "SELECT * FROM o_dense_counts",
    "pair_counts_bidirectional": """SELECT src, dst, CAST(sum(pair_count) AS BIGINT) AS pair_count FROM (SELECT * FROM o_dense_counts
        UNION ALL SELECT dst, src, pair_count FROM o_dense_counts) GROUP BY ALL""",
    "filter_min_support": "SELECT * FROM o_part_counts WHERE pair_count >= 2",
    "cond_prob_edges": f"SELECT src, dst, pair_count, src_count, {r('prob')} AS prob, rank FROM o_part_edges",
    "topk_neighbors": f"SELECT src, dst, pair_count, src_count, {r('prob')} AS prob, rank FROM o_dense_edges WHERE rank <= 10",
    "neighbors_lookup": f"""SELECT src, dst, pair_count, src_count, {r('prob')} AS prob, rank FROM o_dense_edges WHERE rank <= 3
        AND src IN (SELECT item_id FROM o_dense_nodes ORDER BY n DESC, item_id LIMIT 5)""",
    "edge_probability": f"""SELECT c.src, c.dst, {r('coalesce(prob, 0)')} AS prob, m.n FROM o_dense_counts c
        LEFT JOIN o_dense_edges e ON e.src = c.src AND e.dst = c.dst
        JOIN (SELECT item_name, count(DISTINCT restaurant_id) AS n FROM b_items GROUP BY 1) m ON m.item_name = c.src""",
    "graph_summary": f"""SELECT (SELECT count(*) FROM o_part_nodes) AS items, count(*) AS edges,
        {r('count(*) / (SELECT count(*) FROM o_part_nodes)::DOUBLE')} AS avg_neighbors, {r('min(prob)')} AS min_prob,
        {r('max(prob)')} AS max_prob, {r('avg(prob)')} AS mean_prob FROM o_part_edges""",
    "degree_stats": f"""SELECT count(*) AS items, count(*) FILTER (WHERE degree <= 2) AS low_degree,
        count(*) FILTER (WHERE degree >= 20) AS high_degree, min(degree) AS min_degree, max(degree) AS max_degree,
        {r('avg(degree)')} AS mean_degree, {r('100.0 * count(*) FILTER (WHERE degree <= 2) / count(*)')} AS low_pct,
        {r('100.0 * count(*) FILTER (WHERE degree >= 20) / count(*)')} AS high_pct,
        {r('quantile_cont(degree, 0.5)')} AS median_degree FROM o_degree""",
    "top_degree": "SELECT item_id, n, degree FROM o_degree JOIN o_part_nodes USING (item_id) ORDER BY degree DESC, item_id LIMIT 10",
    "top_items": "SELECT item_id, n FROM o_part_nodes ORDER BY n DESC, item_id LIMIT 20",
    "symmetrize_edges": f"SELECT src, dst, {r('weight')} AS weight FROM o_sym",
    "item_index": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM o_part_nodes",
    "negative_samples": f"""SELECT a.session_id, a.step_number, a.item_id, {text_list('n.negatives')} AS negatives FROM b_adds a
        LEFT JOIN (SELECT session_id, step_number, list(item_id ORDER BY pick) AS negatives FROM o_negatives GROUP BY ALL) n
        ON n.session_id = a.session_id AND n.step_number = a.step_number""",
    "union_events": "SELECT candidate_item, CAST(label AS BIGINT) AS label, meal_type, user_type, count(*) AS n FROM o_events GROUP BY ALL",
    "session_sample": """SELECT session_id, step_number, item_id FROM b_adds
        WHERE (('0x' || substr(md5('7|' || session_id), 1, 7))::BIGINT + 0.5) / 268435456.0 < 0.25""",
    "time_split": """SELECT session_id, rows, upto, CASE WHEN upto <= floor(sum(rows) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS split
        FROM (SELECT *, CAST(sum(rows) OVER (ORDER BY ts, session_id) AS BIGINT) AS upto FROM (
          SELECT session_id, max(ts) AS ts, count(*) AS rows FROM b_adds JOIN b_sessions USING (session_id) GROUP BY session_id))""",
    "popularity_pool": """SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY popularity_rank) AS pool_rank
        FROM (SELECT session_id, restaurant_id FROM o_adds WHERE step_number = 0) f JOIN o_popular p USING (restaurant_id)
        WHERE NOT EXISTS (SELECT 1 FROM b_adds a WHERE a.session_id = f.session_id AND a.item_id = p.item_id) QUALIFY pool_rank <= 10""",
    "anti_join_cart": """SELECT s.session_id, s.step_number, count(p.item_id) AS free_items, CAST(coalesce(sum(p.item_id), 0) AS BIGINT) AS free_id_sum
        FROM o_state s LEFT JOIN (SELECT restaurant_id, item_id FROM b_items) p
        ON p.restaurant_id = s.restaurant_id AND NOT list_contains(s.cart_items, p.item_id)
        WHERE s.step_number > 0 GROUP BY s.session_id, s.step_number""",
    "transition_matrix": f"""SELECT from_category, to_category, n, {r('n / sum(n) OVER (PARTITION BY from_category)')} AS rate FROM (
        SELECT from_category, item_category AS to_category, count(*) AS n FROM (SELECT item_category,
          lag(item_category) OVER (PARTITION BY session_id ORDER BY step_number) AS from_category FROM o_adds)
        WHERE from_category IS NOT NULL GROUP BY ALL)""",
    "user_rfm": "SELECT " + ", ".join(["user_id", "recency_days", "frequency"] + [
        f"{r(c)} AS {c}" for c in ("monetary_avg", "cuisine_entropy", "avg_cart_size", "dessert_ratio", "beverage_ratio")]) + " FROM o_users",
    "merchant_features": f"""SELECT restaurant_id, {r('smoothed_rating')} AS smoothed_rating, delivery_votes,
        {r('avg_item_price')} AS avg_item_price, {big('price_band_index')} AS price_band_index, menu_size FROM o_merchants""",
    "item_features": "SELECT * FROM o_item_features",
    "fit_scalers": f"SELECT table_name, feature, transform, {r('p1')} AS p1, {r('p2')} AS p2 FROM o_scalers",
    "apply_scalers": "SELECT user_id, " + ", ".join(f"{r(c)} AS {c}" for c in vocab.DEFAULT_USER_VECTOR) + " FROM o_user_norm",
    "apply_scalers_restaurant": "SELECT restaurant_id, " + ", ".join(f"{r(c)} AS {c}" for c in vocab.DEFAULT_RESTAURANT_VECTOR) + " FROM o_merchant_norm",
    "join_features_default": "SELECT s.session_id, s.step_number, " + ", ".join(
        f"{r(f'coalesce({c}, {d})')} AS {c}" for c, d in {**vocab.DEFAULT_USER_VECTOR, **vocab.DEFAULT_RESTAURANT_VECTOR}.items()
    ) + """ FROM o_steps s LEFT JOIN (SELECT * FROM o_user_norm WHERE frequency >= 8) u ON u.user_id = s.user_id
        LEFT JOIN (SELECT * FROM o_merchant_norm WHERE delivery_votes > 2400) r ON r.restaurant_id = s.restaurant_id""",
    "join_item_lookup": """SELECT candidate_item, embedding_idx, category_index, count(*) AS n FROM o_events
        JOIN o_item_features ON item_id = candidate_item GROUP BY ALL""",
    "join_cart_items": f"""SELECT session_id, step_number, count(*) AS cart_size,
        {r('CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE)')} AS cart_value, {r(xmean('price'))} AS avg_price,
        count(*) FILTER (WHERE item_category = 'main') AS mains, count(*) FILTER (WHERE item_category = 'side') AS sides
        FROM o_cart_lines JOIN b_items ON item_id = cart_item GROUP BY session_id, step_number""",
    "filter_embedded": """SELECT candidate_item, CAST(label AS BIGINT) AS label, count(*) AS n FROM o_events
        WHERE candidate_item IN (SELECT item_id FROM o_index) GROUP BY ALL""",
    "cart_features": f"""SELECT session_id, step_number, len(cart_items) AS cart_size, {r('cart_total', 2)} AS cart_value,
        {NO_BEV} AS missing_beverage, {NO_DES} AS missing_dessert, {HEAVY} AS heavy_meal FROM o_state""",
    "cart_features_scaled": f"""SELECT session_id, step_number, {r('cart_total / 1000.0')} AS cart_total_scaled,
        {r('len(cart_items) / 10.0')} AS cart_size_scaled, {r('coalesce(cart_total / nullif(len(cart_items), 0), 0) / 500.0')} AS avg_price_scaled,
        {NO_BEV} AS missing_beverage, {NO_DES} AS missing_dessert, {HEAVY} AS heavy_meal FROM o_state""",
    "training_set": f"""SELECT * REPLACE (CAST(label AS BIGINT) AS label, {r('cart_value', 2)} AS cart_value,
        {text_list('cart_embedding_indices')} AS cart_embedding_indices) FROM o_training""",
    "class_balance": f"""SELECT {big('sum(label)')} AS positives, {big('sum(1 - label)')} AS negatives,
        {r('sum(1 - label) / sum(label)::DOUBLE')} AS pos_weight, {r('avg(label)')} AS prior FROM o_events""",
    "alignment_check": """SELECT 'candidate' AS "check", count(*) AS checked, count(*) FILTER (WHERE i.item_id IS DISTINCT FROM candidate_item)
          AS mismatches FROM o_training t LEFT JOIN o_index i ON i.idx = t.embedding_idx
        UNION ALL SELECT 'cart', count(*), count(*) FILTER (WHERE i.item_id IS NULL)
        FROM (SELECT unnest(cart_embedding_indices) AS idx FROM o_training) c LEFT JOIN o_index i ON i.idx = c.idx""",
    "category_centroids": f"""SELECT c.item_category, {vector_list('centroid')} AS centroid, k.items FROM o_centroids c JOIN (
        SELECT item_category, count(*) AS items FROM o_known_vectors GROUP BY ALL UNION ALL SELECT NULL, count(*) FROM o_known_vectors) k
        ON k.item_category IS NOT DISTINCT FROM c.item_category""",
    "fix_zero_embeddings": f"SELECT item_id, item_category, CAST(was_zero AS BIGINT) AS was_zero, {vector_list('vector')} AS vector FROM o_unit",
    "aligned_embeddings": f"""SELECT i.item_id, row_number() OVER (ORDER BY i.item_id) - 1 AS idx,
        {vector_list('coalesce(vector, list_transform(range(64), lambda x: CAST(0 AS DOUBLE)))')} AS vector
        FROM b_items i LEFT JOIN b_vectors v ON v.item_id = i.item_id""",
    "similar_items": f"""SELECT query_item, item_id, {r('cosine')} AS cosine, rank FROM (
        SELECT q.item_id AS query_item, v.item_id, list_dot_product(q.vector, v.vector) AS cosine,
          row_number() OVER (PARTITION BY q.item_id ORDER BY list_dot_product(q.vector, v.vector) DESC, v.item_id) AS rank
        FROM o_unit q JOIN o_unit v ON v.item_id <> q.item_id WHERE q.item_id IN (SELECT item_id FROM o_part_nodes
          WHERE item_id IN (SELECT item_id FROM b_vectors) ORDER BY n DESC, item_id LIMIT 5)) WHERE rank <= 10""",
    "similar_items_indexed": f"""SELECT query_item, item_id, {r('cosine')} AS cosine, rank FROM (
        SELECT q.item_id AS query_item, v.item_id, list_dot_product(q.vector, v.vector) AS cosine,
          row_number() OVER (PARTITION BY q.item_id ORDER BY list_dot_product(q.vector, v.vector) DESC, v.item_id) AS rank
        FROM o_unit q JOIN o_unit v ON v.item_id <> q.item_id WHERE q.item_id % 20 = 0) WHERE rank <= 10""",
    "cart_vector": f"SELECT session_id, step_number, {vector_list('cart_vector')} AS cart_vector FROM o_cart_vector",
    "interaction_features": f"""SELECT session_id, step_number, c.item_id, {r('list_dot_product(cart_vector, vector)')} AS interaction_dot,
        {r('list_sum(list_transform(range(1, 65), lambda i: abs(cart_vector[i] - vector[i])))')} AS abs_sum
        FROM o_cart_vector c JOIN o_unit u ON u.item_id = c.item_id""",
    "recommend_cooc": f"""SELECT request_id, item_id, {r('score')} AS score, rank FROM (
        SELECT c.request_id, dst AS item_id, sum(CAST(floor(prob * 1e12 + 0.5) AS BIGINT)) / 1e12::DOUBLE AS score,
          row_number() OVER (PARTITION BY c.request_id ORDER BY sum(CAST(floor(prob * 1e12 + 0.5) AS BIGINT)) / 1e12::DOUBLE DESC, dst) AS rank
        FROM (SELECT DISTINCT session_id AS request_id, item_name FROM o_adds) c JOIN o_dense_edges ON src = item_name
        WHERE NOT EXISTS (SELECT 1 FROM o_adds a WHERE a.session_id = c.request_id AND a.item_name = dst)
        GROUP BY c.request_id, dst) WHERE rank <= 8""",
    "recommend_topk": f"""SELECT request_id, x.item_id, {r('score')} AS score, rank, item_name, price, item_category AS category FROM (
        SELECT c.session_id AS request_id, dst AS item_id, sum(CAST(floor(prob * 1e12 + 0.5) AS BIGINT)) / 1e12::DOUBLE AS score,
          row_number() OVER (PARTITION BY c.session_id ORDER BY sum(CAST(floor(prob * 1e12 + 0.5) AS BIGINT)) / 1e12::DOUBLE DESC, dst) AS rank
        FROM b_adds c JOIN o_part_edges ON src = item_id
        WHERE NOT EXISTS (SELECT 1 FROM b_adds a WHERE a.session_id = c.session_id AND a.item_id = dst)
        GROUP BY c.session_id, dst) x LEFT JOIN b_items i ON i.item_id = x.item_id WHERE rank <= 8""",
    "gap_heuristic_score": f"""SELECT candidate_item, CAST(label AS BIGINT) AS label,
        {NO_BEV} * CAST(item_category = 'beverage' AS BIGINT) AS score, count(*) AS n
        FROM o_events JOIN b_items ON item_id = candidate_item GROUP BY ALL""",
    "read_parquet": "SELECT p_partkey, p_brand, p_retailprice FROM part",
    "write_tables": "SELECT * FROM b_items",
    "write_edges": f"SELECT src, dst, pair_count, src_count, {r('prob')} AS prob, rank FROM o_dense_edges",
    "write_events": "SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS event_date, CAST(label AS BIGINT) AS label, count(*) AS n FROM o_events GROUP BY ALL",
    "write_embeddings": f"""SELECT i.item_id, i.idx, {vector_list('vector')} AS vector FROM o_index i JOIN b_vectors v ON v.item_id = i.item_id""",
    "rank_labels": "SELECT CAST(label AS BIGINT) AS label, rank, count(*) AS n FROM o_popular_ranked GROUP BY ALL",
    "mrr": f"SELECT session_id, step_number, {r('mrr')} AS mrr FROM o_step_metrics WHERE policy = 'popularity'",
    "metrics_table": f"""SELECT m.metric, {r('m.value')} AS model, {r('b.value')} AS baseline,
        {r('100.0 * (m.value - b.value) / nullif(b.value, 0)')} AS improvement_pct
        FROM o_means m JOIN o_means b ON b.metric = m.metric AND b.policy = 'random' WHERE m.policy = 'popularity'""",
    "random_baseline": f"SELECT policy, metric, {r('value')} AS value FROM o_means WHERE policy = 'random'",
    "popularity_ranking": "SELECT session_id, step_number, candidate_item, CAST(label AS BIGINT) AS label FROM o_popular_ranked WHERE rank = 1",
    "accepted_addons": f"SELECT policy, session_id, step_number, accepted, {r('value')} AS value, first_position FROM o_accepted WHERE policy = 'popularity'",
    "policy_metrics": "SELECT policy, steps, " + ", ".join(f"{r(c)} AS {c}" for c in (
        "attach_rate", "addons_per_accepting", "avg_addon_price", "revenue", "revenue_per_step", "items_per_step", "avg_position")) + " FROM o_policy_metrics",
    "policy_lift": " UNION ALL ".join(f"""SELECT p.policy, '{c}' AS metric, {r(f'p.{c}')} AS value, {r(f'b.{c}')} AS base_value,
        {r(f'100.0 * (p.{c} - b.{c}) / nullif(b.{c}, 0)')} AS lift_pct FROM o_policy_metrics p JOIN o_policy_metrics b ON b.policy = 'popularity'
        WHERE p.policy <> 'popularity'""" for c in (
        "attach_rate", "addons_per_accepting", "avg_addon_price", "revenue", "revenue_per_step", "items_per_step", "avg_position")),
    "revenue_projection": f"""SELECT p.policy, {r('960000.0::DOUBLE * p.attach_rate * p.avg_addon_price')} AS daily_revenue,
        {r('960000.0::DOUBLE * p.attach_rate * p.avg_addon_price - 960000.0::DOUBLE * b.attach_rate * p.avg_addon_price')} AS daily_uplift,
        {r('(960000.0::DOUBLE * p.attach_rate * p.avg_addon_price - 960000.0::DOUBLE * b.attach_rate * p.avg_addon_price) * 365')} AS annual_uplift
        FROM o_policy_metrics p JOIN o_policy_metrics b ON b.policy = 'popularity'""",
    "auc_exact": f"""SELECT policy, {big('sum(pos)')} AS positives, {big('sum(neg)')} AS negatives,
        {r('sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg))')} AS auc
        FROM (SELECT *, coalesce(CAST(sum(neg) OVER (PARTITION BY policy ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)
          AS below FROM o_score_counts) GROUP BY policy""",
    "average_precision": f"""SELECT policy, {big('sum(pos)')} AS positives, {r('sum(pos * (cp / (cp + cn))) / sum(pos)::DOUBLE')} AS average_precision
        FROM (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(neg) OVER w AS DOUBLE) AS cn FROM o_score_counts
          WINDOW w AS (PARTITION BY policy ORDER BY score DESC)) GROUP BY policy""",
    "menu_size_anomalies": """SELECT restaurant_id, count(*) AS menu_size, CASE WHEN count(*) < 3 THEN 'few' ELSE 'many' END AS kind
        FROM o_menu GROUP BY restaurant_id HAVING count(*) < 3 OR count(*) > 100""",
    "price_outliers": """SELECT item_id, restaurant_id, price, 'extreme' AS kind FROM o_menu WHERE price > (SELECT q3 + 3 * (q3 - q1)
          FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM o_menu))
        UNION ALL SELECT item_id, restaurant_id, price, 'cheap' FROM o_menu WHERE price <= 10
        UNION ALL SELECT * FROM (SELECT item_id, restaurant_id, price, 'dearest' FROM o_menu ORDER BY price DESC, item_id LIMIT 10)""",
    "attach_rates": f"""SELECT item_category, count(*) AS items, {r('100.0 * count(*) / (SELECT count(DISTINCT session_id) FROM b_adds)')} AS rate_pct
        FROM o_adds GROUP BY item_category""",
    "positive_rate_by_category": f"""SELECT item_category, count(*) AS shown, {big('sum(label)')} AS positives, {r('avg(label)')} AS positive_rate,
        {r('100.0 * sum(label) / (SELECT sum(label) FROM o_events)')} AS positive_share_pct,
        {r('100.0 * sum(1 - label) / (SELECT sum(1 - label) FROM o_events)')} AS negative_share_pct
        FROM o_events JOIN b_items ON item_id = candidate_item GROUP BY item_category""",
    "null_audit": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, """
        + ("count(*) FILTER (WHERE len(cart_embedding_indices) = 0)" if c == "cart_embedding_indices" else "CAST(NULL AS BIGINT)")
        + " AS empty_lists FROM o_training" for c in (
            "session_id", "step_number", "user_id", "restaurant_id", "candidate_item", "label", "hour", "meal_type_idx", "user_type_idx",
            "embedding_idx", "cart_size", "cart_value", "missing_beverage", "missing_dessert", "heavy_meal", "cart_embedding_indices")),
}

# Long reports ------------------------------------------------------------------------------------


def total(source: str, section: str, **metrics: str) -> list[str]:
    return [f"SELECT '{section}' AS section, '{n}' AS metric, {r(x)} AS value FROM {source}" for n, x in metrics.items()]


def mix(source: str, column: str, section: str) -> list[str]:
    return [f"SELECT '{section}' AS section, CAST({column} AS VARCHAR) AS metric, "
            f"{r('100.0 * count(*) / sum(count(*)) OVER ()')} AS value FROM {source} GROUP BY {column}"]


def stats(source: str, column: str, zero: bool, **quantiles: float) -> list[str]:
    metrics = {"min": f"min({column})", "mean": f"avg({column})", "max": f"max({column})", "std": f"stddev_samp({column})"}
    metrics |= {n: f"quantile_cont({column}, {q})" for n, q in quantiles.items()}
    if zero:
        metrics["zero_pct"] = f"100.0 * count(*) FILTER (WHERE {column} = 0) / count(*)"
    return total(source, column, **metrics)


def top5(source: str, column: str) -> list[str]:
    return [f"SELECT * FROM (SELECT 'top_{column}' AS section, {column} AS metric, CAST(count(*) AS DOUBLE) AS value FROM {source} "
            f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 5)"]


def report(*parts: list[str]) -> str:
    return " UNION ALL ".join(x for part in parts for x in part)


BLOCKS["o_menu_sizes"] = "SELECT restaurant_id, count(*) AS menu_size FROM b_items GROUP BY restaurant_id"
FINAL["cleaning_summary"] = report(
    total("b_raw_menu", "raw", raw_rows="count(*)"),
    total("o_restaurants", "restaurants", restaurants="count(*)", cities="count(DISTINCT city)", cuisines="count(DISTINCT cuisine)",
          max_delivery_rating="max(delivery_rating)", max_dining_rating="max(dining_rating)",
          compression_pct="100.0 * count(*) / (SELECT count(*) FROM b_raw_menu)"),
    total("o_menu", "menu", items="count(*)", item_names="count(DISTINCT item_name)", min_price="min(price)", max_price="max(price)",
          best_sellers="sum(best_seller)", retained_pct="100.0 * count(*) / (SELECT count(*) FROM b_raw_menu)"),
    top5("o_restaurants", "city"), top5("o_restaurants", "cuisine"))
FINAL["category_summary"] = report(
    total("o_dishes", "total", items="count(*)", mean_confidence="avg(category_confidence)", mean_veg_confidence="avg(veg_confidence)",
          unknown_pct="100.0 * count(*) FILTER (WHERE item_category = 'unknown') / count(*)",
          low_confidence="count(*) FILTER (WHERE category_confidence < 0.5)", median_confidence="quantile_cont(category_confidence, 0.5)"),
    mix("o_dishes", "item_category", "category_pct"), mix("o_dishes", "veg_flag", "veg_pct"))
FINAL["profile_merchants"] = report(
    total("o_restaurants", "total", restaurants="count(*)"), mix("o_restaurants", "city", "city_pct"),
    stats("o_restaurants", "delivery_rating", False, median=0.5), stats("o_restaurants", "delivery_votes", True, median=0.5, p95=0.95))
FINAL["profile_items"] = report(
    total("b_items", "total", items="count(*)", best_seller_pct="100.0 * sum(best_seller) / count(*)"),
    stats("o_menu_sizes", "menu_size", False, median=0.5), stats("b_items", "price", False, median=0.5, p95=0.95, p99=0.99),
    mix("b_items", "item_category", "category_pct"), stats("b_items", "item_votes", True, median=0.5, p95=0.95))

_attributes = ("meal_type", "user_type", "city", "hour")
BLOCKS["o_session_mix"] = "SELECT 'label' AS section, CAST(label AS VARCHAR) AS value, count(*) AS n FROM o_events GROUP BY label " + " ".join(
    f"UNION ALL SELECT '{a}', CAST({a} AS VARCHAR), count(*) FROM o_events WHERE label = 1 GROUP BY {a}" for a in _attributes)
FINAL["session_summary"] = f"SELECT section, value, n, {r('100.0 * n / sum(n) OVER (PARTITION BY section)')} AS pct FROM o_session_mix"

_groups = " ".join(
    f"WHEN contains(c, '{x.lower()}') OR contains('{x.lower()}', c) THEN '{g}'" for g, xs in vocab.CUISINE_GROUPS.items() for x in xs)
BLOCKS["o_groups"] = f"SELECT cuisine, CASE {_groups} ELSE 'indian' END AS cuisine_group FROM (SELECT cuisine, lower(cuisine) AS c FROM o_cuisine_names)"
FINAL["cuisine_group"] = "SELECT cuisine, cuisine_group, count(*) AS n FROM o_text JOIN o_groups USING (cuisine) GROUP BY ALL"
LOW = case("user_type", {k: v[0] for k, v in vocab.PRICE_BRACKETS.items()}, "NULL")
HIGH = case("user_type", {k: v[1] or 1e300 for k, v in vocab.PRICE_BRACKETS.items()}, "NULL")


def fit(price: str, inside: float, below: float, above: float) -> str:
    return f"CAST(CASE WHEN {price} < {LOW} THEN {below} WHEN {price} > {HIGH} THEN {above} ELSE {inside} END AS DOUBLE)"


FINAL["price_fit"] = f"""SELECT user_type, {fit('price', 1.2, 0.7, 0.5)} AS merchant_fit, {fit('price', 1.0, 0.6, 0.3)} AS item_fit,
    count(*) AS n FROM o_steps GROUP BY ALL"""
FINAL["merchant_affinity"] = f"""SELECT user_id, restaurant_id, {r('w / sum(w) OVER (PARTITION BY user_id)')} AS probability FROM (
    SELECT user_id, m.restaurant_id, greatest(0.1, least(1.0, (m.smoothed_rating - 3.0) / 1.5))
      * CASE WHEN m.delivery_votes > 0 THEN least(1.5, ln(1 + m.delivery_votes) / ln(1001)) ELSE 0.5 END
      * CASE WHEN list_contains(string_split(preferred_cuisines, '|'), cuisine_group) THEN 1.5 ELSE 0.8 END
      * {fit('coalesce(p.avg_item_price, 200)', 1.2, 0.7, 0.5)} AS w
    FROM b_users u JOIN o_smoothed m ON m.city = u.city JOIN o_groups g ON g.cuisine = m.cuisine
    JOIN o_price_stats p ON p.restaurant_id = m.restaurant_id)"""
_boost = " ".join(
    f"WHEN meal_type = '{meal}' AND item_category = '{c}' THEN {w}" for meal, row in vocab.FIRST_ITEM_BOOST.items() for c, w in row.items())
FINAL["first_item_affinity"] = f"""SELECT restaurant_id, user_type, meal_type, item_id,
    {r('w / sum(w) OVER (PARTITION BY restaurant_id, user_type, meal_type)')} AS probability FROM (
    SELECT c.*, item_id, (0.5::DOUBLE * norm_votes + 0.3::DOUBLE * best_seller + 0.2::DOUBLE * {fit('price', 1.0, 0.6, 0.3)})
      * CAST(CASE {_boost} ELSE 1.0 END AS DOUBLE) AS w
    FROM (SELECT DISTINCT restaurant_id, user_type, meal_type FROM o_steps) c JOIN o_norm_votes USING (restaurant_id))"""
_moves = " ".join(
    f"WHEN last = '{a}' AND m.item_category = '{b}' THEN {w}" for a, row in vocab.CATEGORY_TRANSITIONS.items() for b, w in row.items())
BLOCKS["o_choices"] = f"""
    SELECT s.session_id, s.step_number, s.item_id, m.item_id AS option,
      CASE WHEN list_contains(s.cart_items, m.item_id) THEN 0 ELSE
      (0.15::DOUBLE * m.norm_votes + 0.35::DOUBLE * m.best_seller + 0.5::DOUBLE)
      * CAST(CASE {_moves} WHEN last IN ('main', 'side', 'beverage', 'dessert') THEN 0.1 ELSE 1.0 END AS DOUBLE)
      * CASE m.item_category
          WHEN 'beverage' THEN (CASE WHEN has_main AND NOT list_contains(cart_categories, 'beverage') THEN 6 ELSE 1 END)
                             * (CASE WHEN s.meal_type IN ('lunch', 'dinner') THEN 2 ELSE 1 END)
          WHEN 'dessert' THEN (CASE WHEN heavy = 1 THEN 4 ELSE 1 END) * (CASE WHEN s.user_type IN ('premium', 'luxury') THEN 3 ELSE 1 END)
          WHEN 'main' THEN CASE WHEN has_main THEN 0.5::DOUBLE ELSE 1 END ELSE 1 END
      * CASE WHEN len(list_filter(cart_categories, lambda c: c = m.item_category)) >= 2 THEN 0.3::DOUBLE ELSE 1 END
      * CASE WHEN m.price <= greatest(50, u.avg_order_value - s.cart_total) THEN 1 ELSE 0.3::DOUBLE END END AS w
    FROM (SELECT *, cart_categories[-1] AS last, list_contains(cart_categories, 'main') AS has_main, {HEAVY} AS heavy
          FROM o_steps WHERE step_number > 0) s
    JOIN b_users u ON u.user_id = s.user_id JOIN o_norm_votes m ON m.restaurant_id = s.restaurant_id"""
FINAL["next_item_affinity"] = f"""SELECT session_id, step_number, item_id, count(*) AS choices,
    {r('100.0 * max(CASE WHEN option = item_id THEN w END) / sum(w)')} AS added_pct,
    {r('100.0 * max(w) / sum(w)')} AS best_pct
    FROM o_choices GROUP BY session_id, step_number, item_id"""


def signal(scope: str, name: str, condition: str, outcome: str) -> str:
    source = "o_session_flags" if scope == "session" else "o_step_flags"
    return (f"SELECT '{scope}' AS scope, '{name}' AS signal, count(*) FILTER (WHERE {condition}) AS base, "
            f"count(*) FILTER (WHERE ({condition}) AND {outcome}) AS hits, "
            f"{r(f'count(*) FILTER (WHERE ({condition}) AND {outcome}) / count(*) FILTER (WHERE {condition})::DOUBLE')} AS rate FROM {source}")


BLOCKS["o_session_flags"] = """
    SELECT session_id, user_type IN ('premium', 'luxury') AS premium, meal_type IN ('lunch', 'dinner') AS big_meal,
      count(*) FILTER (WHERE item_category = 'main') AS mains, count(*) FILTER (WHERE item_category = 'side') AS sides,
      bool_or(item_category = 'beverage') AS beverage, bool_or(item_category = 'dessert') AS dessert
    FROM o_steps GROUP BY session_id, user_type, meal_type"""
BLOCKS["o_step_flags"] = f"""
    SELECT user_type IN ('premium', 'luxury') AS premium, meal_type IN ('lunch', 'dinner') AS big_meal,
      list_contains(cart_categories, 'main') AND NOT list_contains(cart_categories, 'beverage') AS gap, {HEAVY} = 1 AS heavy,
      item_category = 'beverage' AS beverage, item_category = 'dessert' AS dessert FROM o_steps"""
_heavy_session = "mains >= 2 OR (mains >= 1 AND sides >= 1)"
FINAL["conditional_attach"] = " UNION ALL ".join(
    [signal("session", "main_beverage", "mains > 0", "beverage"), signal("session", "heavy_dessert", _heavy_session, "dessert"),
     signal("step", "main_gap_beverage", "gap", "beverage"), signal("step", "heavy_dessert", "heavy", "dessert")]
    + [signal(s, n, c, o) for s in ("session", "step") for n, c, o in (
        ("premium_dessert", "premium", "dessert"), ("other_user_dessert", "NOT premium", "dessert"),
        ("lunch_dinner_beverage", "big_meal", "beverage"), ("other_meal_beverage", "NOT big_meal", "beverage"))])
_flags = {"is_beverage": "CAST(category_index = 3 AS INT)", "is_dessert": "CAST(category_index = 2 AS INT)",
          "is_main": "CAST(category_index = 0 AS INT)", "missing_beverage": "missing_beverage", "missing_dessert": "missing_dessert",
          "heavy_meal": "heavy_meal", "missing_bev_x_is_bev": "missing_beverage * CAST(category_index = 3 AS INT)",
          "missing_des_x_is_des": "missing_dessert * CAST(category_index = 2 AS INT)",
          "heavy_x_is_des": "heavy_meal * CAST(category_index = 2 AS INT)"}
BLOCKS["o_flagged"] = "SELECT t.*, f.category_index FROM o_training t JOIN o_item_features f ON f.item_id = t.candidate_item"
FINAL["label_correlations"] = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {r(f'corr(CAST({x} AS DOUBLE), CAST(label AS DOUBLE))')} AS correlation FROM o_flagged" for n, x in _flags.items())
BLOCKS["o_loose_menu"] = "SELECT item_id, max(restaurant_id) AS restaurant_id, max(price) AS price FROM o_priced GROUP BY item_id"
_loose_sizes = "(SELECT count(*) AS n FROM o_loose_menu GROUP BY restaurant_id)"
FINAL["recommended_actions"] = f"""SELECT * FROM (
    SELECT 'filter_small_menus' AS action, count(*) AS affected FROM {_loose_sizes} WHERE n < 3
    UNION ALL SELECT 'review_large_menus', count(*) FROM {_loose_sizes} WHERE n > 100
    UNION ALL SELECT 'review_price_outliers', count(*) FROM o_loose_menu WHERE price > (SELECT q3 + 3 * (q3 - q1) FROM (
      SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM o_loose_menu))
    UNION ALL SELECT 'many_restaurants_without_votes', CASE WHEN avg(CAST(delivery_votes = 0 AS INT)) > 0.5
      THEN count(*) FILTER (WHERE delivery_votes = 0) ELSE 0 END FROM o_restaurants
    UNION ALL SELECT 'fix_orphan_items', count(DISTINCT restaurant_id) FROM o_loose_menu
      WHERE restaurant_id NOT IN (SELECT restaurant_id FROM o_restaurants)
    UNION ALL SELECT 'drop_restaurants_without_menu', count(*) FROM o_restaurants
      WHERE restaurant_id NOT IN (SELECT restaurant_id FROM o_loose_menu)) WHERE affected > 0"""
FINAL["read_raw_csv"] = "SELECT restaurant_name, city, item_name, price, count(*) AS n FROM b_raw_menu GROUP BY ALL"
FINAL["normalize_headers"] = """SELECT restaurant_name, CAST(NULL AS VARCHAR) AS dining_rating, CAST(NULL AS VARCHAR) AS delivery_rating,
    CAST(NULL AS VARCHAR) AS dining_votes, CAST(NULL AS VARCHAR) AS delivery_votes, cuisine, place, city, item_name,
    CAST(NULL AS VARCHAR) AS best_seller, CAST(NULL AS VARCHAR) AS item_votes, price, count(*) AS n FROM b_raw_menu GROUP BY ALL"""
BLOCKS["o_heuristic"] = f"""
    SELECT label, CASE WHEN {NO_BEV} = 1 AND item_category = 'beverage' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS score
    FROM o_events JOIN b_items ON item_id = candidate_item"""
BLOCKS["o_heuristic_counts"] = "SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM o_heuristic GROUP BY score"
FINAL["train_eval"] = f"""SELECT 'heuristic' AS run, {big('sum(pos)')} AS positives, {big('sum(neg)')} AS negatives,
    {r('sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg))')} AS auc,
    {r('sum(pos * (cp / (cp + cn))) / sum(pos)::DOUBLE')} AS average_precision,
    {r('sum(pos * -ln(score) * (SELECT sum(1 - label) / sum(label)::DOUBLE FROM o_heuristic) + neg * -ln(1 - score)) / sum(pos + neg)')} AS loss
    FROM (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(neg) OVER w AS DOUBLE) AS cn,
      coalesce(CAST(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS below
      FROM o_heuristic_counts WINDOW w AS (ORDER BY score DESC))"""

# First step of a walk: inverse of the cumulative transition weights in node order.
BLOCKS["o_cdf"] = """
    SELECT src, dst, (cum - weight) / total AS low, CASE WHEN pos = degree THEN 1.0 ELSE cum / total END AS high FROM (
      SELECT *, sum(weight) OVER (PARTITION BY src ORDER BY dst) AS cum, sum(weight) OVER (PARTITION BY src) AS total,
        row_number() OVER (PARTITION BY src ORDER BY dst) AS pos, count(*) OVER (PARTITION BY src) AS degree FROM o_sym)"""
FINAL["random_walk_first_step"] = """SELECT walk_id, x.src, dst FROM (
    SELECT src, src || '#' || w AS walk_id, (('0x' || substr(md5('42|' || src || '#' || w || '|1|0'), 1, 7))::BIGINT + 0.5::DOUBLE)
      / 268435456.0::DOUBLE AS u FROM (SELECT DISTINCT src FROM o_sym), (SELECT unnest(range(10)) AS w)) x
    JOIN o_cdf c ON c.src = x.src AND low <= u AND u < high"""

# Streams: what the batch query gives for the windows that the watermark closes.
BLOCKS["o_activity"] = """
    SELECT ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CAST(event_type = 'purchase' AS BIGINT) AS added,
      CAST(event_type IN ('click', 'view', 'purchase') AS BIGINT) AS shown, hour(ts) AS hour FROM events"""
BLOCKS["o_activity_meal"] = f"SELECT *, {MEAL} AS meal_type FROM o_activity"
_stamp = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
FINAL["stream_attach_rate"] = f"""SELECT {_stamp.format('w')} AS window_start, meal_type, {big('sum(added)')} AS adds, {big('sum(shown)')} AS shown,
    {r('sum(added) / nullif(sum(shown), 0)::DOUBLE')} AS attach_rate FROM (SELECT *, date_trunc('hour', ts) AS w FROM o_activity_meal)
    GROUP BY w, meal_type HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
FINAL["stream_top_items"] = f"""SELECT {_stamp.format('w')} AS window_start, item_id, adds, rank FROM (
    SELECT w, item_id, count(*) AS adds, row_number() OVER (PARTITION BY w ORDER BY count(*) DESC, item_id) AS rank FROM (
      SELECT item_id, ts, unnest([0, 15, 30, 45]) AS back, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(back) AS w
      FROM o_activity WHERE added = 1) GROUP BY w, item_id
    HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM o_activity WHERE added = 1) - INTERVAL 10 MINUTE) WHERE rank <= 5"""
FINAL["stream_sessions"] = f"""SELECT user_id, {_stamp.format('min(ts)')} AS session_start,
    {_stamp.format('max(ts) + INTERVAL 30 MINUTE')} AS session_end, count(*) AS events FROM (
      SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM (
        SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS INT) AS fresh
        FROM events)) GROUP BY user_id, visit
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
FINAL["stream_enrich"] = f"""SELECT session_id, l_linenumber, item_id, item_category, price, user_type, meal_type, category_index, is_beverage FROM (
    SELECT l_orderkey AS session_id, {big('l_linenumber')} AS l_linenumber, item_id, item_category, price, user_type, {MEAL} AS meal_type,
      CAST({CATEGORY} AS BIGINT) AS category_index, CAST(item_category = 'beverage' AS BIGINT) AS is_beverage
    FROM lineitem JOIN b_items ON item_id = l_partkey JOIN b_sessions ON session_id = l_orderkey)"""
FINAL["stream_recommend"] = FINAL["recommend_cooc"]
FINAL["global_stable_sort"] = FINAL["ordered_sequence"] + " ORDER BY session_id"
FINAL["join_menu_stats"] = FINAL["merchant_price_stats"]
FINAL["write_training_set"] = FINAL["training_set"]
FINAL["write_scalers"] = FINAL["fit_scalers"]
for _m in ("precision", "recall", "ndcg", "acceptance"):
    FINAL[f"{_m}_at_k"] = ("SELECT session_id, step_number, " + ", ".join(f"{r(f'{_m}_{k}')} AS {_m}_{k}" for k in KS)
                           + " FROM o_step_metrics WHERE policy = 'popularity'")


def statements() -> dict[str, str]:
    return {name: build(final) for name, final in FINAL.items()}
