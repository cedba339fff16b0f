"""Vocabularies, lookup tables and numeric settings of the cart model."""

from __future__ import annotations

# ---- Fixed values: results depend on these exact entries -------------------------------------

# Header of the raw menu export -> column of the cart model (matched trimmed, without case).
RAW_HEADERS = {
    "restaurant name": "restaurant_name",
    "dining rating": "dining_rating",
    "delivery rating": "delivery_rating",
    "dining votes": "dining_votes",
    "delivery votes": "delivery_votes",
    "cuisine": "cuisine",
    "place name": "place",
    "place": "place",
    "city": "city",
    "city name": "city",
    "item name": "item_name",
    "best seller": "best_seller",
    "votes": "item_votes",
    "prices": "price",
}

CITY_ALIASES = {
    "bengaluru": "Bangalore",
    "bangalore": "Bangalore",
    "blr": "Bangalore",
    "mumbai": "Mumbai",
    "bombay": "Mumbai",
    "delhi": "Delhi",
    "new delhi": "Delhi",
    "ncr": "Delhi",
    "chennai": "Chennai",
    "madras": "Chennai",
    "kolkata": "Kolkata",
    "calcutta": "Kolkata",
    "hyderabad": "Hyderabad",
    "hyd": "Hyderabad",
    "pune": "Pune",
    "ahmedabad": "Ahmedabad",
    "ahemdabad": "Ahmedabad",
    "jaipur": "Jaipur",
    "lucknow": "Lucknow",
    "gurgaon": "Gurugram",
    "gurugram": "Gurugram",
    "noida": "Noida",
    "ghaziabad": "Ghaziabad",
    "chandigarh": "Chandigarh",
    "kochi": "Kochi",
    "cochin": "Kochi",
    "indore": "Indore",
    "nagpur": "Nagpur",
    "coimbatore": "Coimbatore",
    "vizag": "Visakhapatnam",
    "visakhapatnam": "Visakhapatnam",
    "surat": "Surat",
    "vadodara": "Vadodara",
    "baroda": "Vadodara",
    "bhopal": "Bhopal",
    "patna": "Patna",
    "thiruvananthapuram": "Thiruvananthapuram",
    "trivandrum": "Thiruvananthapuram",
    "mysore": "Mysuru",
    "mysuru": "Mysuru",
}

# Spellings that plain title case would not give.
CUISINE_ALIASES = {
    "northindian": "North Indian",
    "southindian": "South Indian",
    "indo chinese": "Indo-Chinese",
    "fastfood": "Fast Food",
}

RATING_MISSING = ["--", "-", "new", "n/a", "na", "", "none"]
VOTES_MISSING = RATING_MISSING
PRICE_MISSING = ["--", "-", "n/a", "na", "", "free", "none"]

BESTSELLER_TAGS = [
    "bestseller", "best seller", "must try", "chef's special",
    "chefs special", "popular", "recommended", "top rated",
]
BESTSELLER_FLAGS = ["1", "true"]

CATEGORY_INDEX = {
    "main": 0, "starter": 1, "dessert": 2, "beverage": 3,
    "side": 4, "snack": 5, "combo": 6, "other": 7,
}
MEAL_TYPE_INDEX = {"breakfast": 0, "lunch": 1, "snack": 2, "dinner": 3, "late_night": 4}
USER_TYPE_INDEX = {"budget": 0, "moderate": 1, "premium": 2, "luxury": 3}

# First and last hour of each meal; every other hour is late night.
MEAL_HOURS = {"breakfast": (7, 10), "lunch": (11, 14), "snack": (15, 17), "dinner": (18, 22)}

# Spending bracket per user type; None is open-ended.
PRICE_BRACKETS = {
    "budget": (0.0, 150.0),
    "moderate": (100.0, 350.0),
    "premium": (250.0, 800.0),
    "luxury": (500.0, None),
}

CUISINE_GROUPS = {
    "indian": ["North Indian", "South Indian", "Mughlai", "Biryani", "Street Food"],
    "chinese": ["Chinese", "Indo-Chinese", "Asian", "Thai", "Japanese", "Korean"],
    "western": ["Italian", "Continental", "American", "Mexican", "Mediterranean"],
    "fast_food": ["Fast Food", "Pizza", "Burger", "Rolls", "Wraps", "Sandwiches"],
    "healthy": ["Healthy Food", "Salads", "Juices", "Smoothies"],
    "dessert": ["Desserts", "Ice Cream", "Bakery", "Cafe", "Coffee"],
}

# Cuisine -> category for items whose name says nothing; order decides partial matches.
CUISINE_CATEGORY = {
    "dessert": [
        "bakery", "desserts", "ice cream", "mithai", "sweets", "cakeshop", "cake shop", "confectionery",
    ],
    "beverage": [
        "beverages", "beverage", "juices", "juice", "tea", "coffee", "cafe", "bubble tea", "smoothies", "shakes",
    ],
    "main": [
        "north indian", "south indian", "chinese", "indo-chinese", "italian", "pizza", "burger", "fast food",
        "biryani", "mughlai", "continental", "thai", "mexican", "japanese", "korean", "arabian", "lebanese",
        "mediterranean", "american", "seafood", "asian", "street food", "rolls", "kebabs", "momos", "wraps",
        "sandwiches",
    ],
    "side": ["salads", "soups", "starters"],
}

# Chance that a category follows the last added one.
CATEGORY_TRANSITIONS = {
    "main": {"side": 0.60, "beverage": 0.55, "dessert": 0.25, "main": 0.15},
    "side": {"main": 0.40, "beverage": 0.50, "dessert": 0.30, "side": 0.20},
    "beverage": {"dessert": 0.35, "side": 0.25, "main": 0.20, "beverage": 0.10},
    "dessert": {"beverage": 0.40, "dessert": 0.15, "side": 0.10, "main": 0.05},
}
OTHER_TRANSITION = 0.1

# Weight of an item as first pick, by meal and category.
FIRST_ITEM_BOOST = {
    "breakfast": {"beverage": 1.5, "side": 1.2, "main": 0.8},
    "lunch": {"main": 1.5},
    "dinner": {"main": 1.5},
    "snack": {"dessert": 1.3, "beverage": 1.3},
}

# Normalised vectors for users and restaurants without history.
DEFAULT_USER_VECTOR = {
    "recency_days_norm": 0.0,
    "frequency_norm": 0.0,
    "monetary_avg_norm": 0.0,
    "cuisine_entropy_norm": 0.5,
    "avg_cart_size_norm": 0.0,
    "dessert_ratio_norm": 0.1,
    "beverage_ratio_norm": 0.15,
}
DEFAULT_RESTAURANT_VECTOR = {
    "smoothed_rating_norm": 0.25,
    "delivery_votes_norm": 0.0,
    "avg_item_price_norm": 0.0,
    "price_band_index_norm": 0.5,
    "menu_size_norm": 0.0,
}

MENU_CAP = 120
NEGATIVES_PER_STEP = 5
MIN_PAIR_COUNT = 2
TOP_NEIGHBORS = 50
CANDIDATE_POOL = 50
TOP_RECOMMENDATIONS = 8
EMBEDDING_DIM = 64
CART_LIMIT = 10
DEFAULT_ITEM_PRICE = 100.0
SMOOTHING_VOTES = 50
# ---- End of fixed values ----------------------------------------------------------------------
