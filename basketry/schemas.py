"""Declared schemas of the cart model's stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


RAW_MENU = _schema(
    "restaurant_name string, dining_rating string, delivery_rating string, dining_votes string, delivery_votes string, "
    "cuisine string, place string, city string, item_name string, best_seller string, item_votes string, price string"
)
RESTAURANTS = _schema(
    "restaurant_id string, restaurant_name string, city string, cuisine string, delivery_rating double, "
    "delivery_votes long, dining_rating double, dining_votes long, smoothed_rating double"
)
MENU_ITEMS = _schema(
    "item_id string, restaurant_id string, item_name string, price double, item_votes long, best_seller long, "
    "item_category string, veg_flag int, category_confidence double, veg_confidence double"
)
USERS = _schema(
    "user_id string, user_type string, preferred_cuisines string, avg_order_value double, order_frequency int, city string"
)
CART_EVENTS = _schema(
    "session_id string, step_number int, user_id string, restaurant_id string, cart_items array<string>, "
    "candidate_item string, label int, ts timestamp, city string, hour int, meal_type string, user_type string, "
    "cart_total double, cart_categories array<string>"
)
SEQUENCES = _schema("session_id string, restaurant_id string, item_sequence array<string>")
EDGES = _schema("src string, dst string, pair_count long, src_count long, prob double, rank long")
EMBEDDINGS = _schema("item_id string, idx long, vector array<double>")
SCALERS = _schema("table_name string, feature string, transform string, p1 double, p2 double")
REQUESTS = _schema(
    "request_id string, user_id string, restaurant_id string, cart_items array<string>, hour int, meal_type string, "
    "user_type string"
)
