"""Values that define the scores. FIXED VALUES: results change with any of them."""

SCORE_VERSION = "1.2.1"

#: id, name, country, centre (lat, lon), box (minx, miny, maxx, maxy), expected region
CITIES = [
    ("london", "London", "GB", (51.5074, -0.1278), (-0.52, 51.29, 0.33, 51.68), None),
    ("bangkok", "Bangkok", "TH", (13.7563, 100.5018), (100.32, 13.55, 100.93, 13.95), None),
    ("paris", "Paris", "FR", (48.8566, 2.3522), (2.15, 48.80, 2.50, 48.92), None),
    ("rome", "Rome", "IT", (41.9028, 12.4964), (12.35, 41.82, 12.62, 41.98), None),
    ("barcelona", "Barcelona", "ES", (41.3874, 2.1686), (2.05, 41.32, 2.25, 41.47), None),
    ("amsterdam", "Amsterdam", "NL", (52.3676, 4.9041), (4.80, 52.30, 5.00, 52.42), None),
    ("lisbon", "Lisbon", "PT", (38.7223, -9.1393), (-9.23, 38.68, -9.08, 38.78), None),
    ("sydney", "Sydney", "AU", (-33.8688, 151.2093), (151.00, -33.95, 151.30, -33.75), None),
    ("tokyo", "Tokyo", "JP", (35.6762, 139.6503), (139.60, 35.60, 139.90, 35.78), None),
    ("dubai", "Dubai", "AE", (25.2048, 55.2708), (55.10, 24.95, 55.42, 25.30), None),
    ("new_york", "New York City metro", "US", (40.7128, -74.0060), (-74.28, 40.49, -73.70, 40.92), "NY"),
    ("singapore", "Singapore", "SG", (1.3521, 103.8198), (103.60, 1.22, 104.05, 1.47), None),
]

EARTH_RADIUS_PLANAR_M = 6_378_137.0
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
MARGIN_FACTOR = 1.3

DIMENSIONS = ["walkability_density", "transit_access", "food_essentials", "quietness_proxy", "family_convenience", "nightlife_access"]
DENSITY = ["food_essentials", "walkability_density", "nightlife_access"]

DECAY_M = {"food_essentials": 250, "walkability_density": 250, "transit_access": 400, "nightlife_access": 250, "family_convenience": 350}
ABSOLUTE_WEIGHT = 0.70
SATURATION = {"food_essentials": 6, "walkability_density": 15, "nightlife_access": 4, "family_convenience": 2}
RADIUS_M = {"food_essentials": 400, "walkability_density": 400, "transit_access": 800, "nightlife_access": 400, "family_convenience": 600}
QUIET_START = 100
#: penalty: (weight, scale in metres, radius in metres)
PENALTIES = {"major_road": (45, 100, 150), "rail": (35, 100, 150), "nightlife": (25, 120, 200), "airport": (30, 2500, 5000)}
TRANSIT_BONUS, TRANSIT_BONUS_MODES = 8, 3
CONFIDENCE_WEIGHTS = {"place_confidence": 0.30, "poi_coverage": 0.30, "city_sample_size": 0.20, "dedupe_quality": 0.20}
CITY_SAMPLE_TARGET, DEFAULT_PLACE_CONFIDENCE = 300, 50

PERSONAS = {
    "balanced": {"walkability_density": 0.20, "transit_access": 0.20, "food_essentials": 0.20, "quietness_proxy": 0.15, "family_convenience": 0.10, "nightlife_access": 0.15},
    "quiet_sleep": {"walkability_density": 0.10, "transit_access": 0.15, "food_essentials": 0.15, "quietness_proxy": 0.45, "family_convenience": 0.10, "nightlife_access": 0.05},
    "first_time_tourist": {"walkability_density": 0.25, "transit_access": 0.25, "food_essentials": 0.20, "quietness_proxy": 0.10, "family_convenience": 0.05, "nightlife_access": 0.15},
    "car_free": {"walkability_density": 0.25, "transit_access": 0.40, "food_essentials": 0.15, "quietness_proxy": 0.10, "family_convenience": 0.05, "nightlife_access": 0.05},
    "family": {"walkability_density": 0.20, "transit_access": 0.15, "food_essentials": 0.15, "quietness_proxy": 0.25, "family_convenience": 0.25, "nightlife_access": 0.00},
    "nightlife": {"walkability_density": 0.15, "transit_access": 0.15, "food_essentials": 0.15, "quietness_proxy": 0.05, "family_convenience": 0.00, "nightlife_access": 0.50},
}

HOTEL_TYPES = ["hotel", "resort", "inn", "lodge", "guest_house", "bed_and_breakfast", "hostel", "service_apartment"]
EXCLUDED_TYPES = ["lodging", "holiday_rental_home", "campground", "cabin", "cottage", "rv_park", "ski_resort", "beach_resort", "self_catering_accommodation"]

CATEGORIES = {
    "food_essentials": ["restaurant", "cafe", "bakery", "coffee_shop", "grocery_store", "convenience_store", "pharmacy"],
    "transit_access": ["train_station", "metro_station", "light_rail_and_subway_station", "bus_station", "public_transit_facility_or_service"],
    "nightlife_access": ["bar", "pub", "dance_club", "cocktail_bar", "wine_bar", "brewery", "lounge"],
    "family_convenience": ["aquarium"],
}
FAMILIES = {"walkability_density": ["shopping", "food_and_drink", "health_care", "lifestyle_services", "arts_and_entertainment"]}
DISPLAY_ONLY = ["park", "playground", "zoo"]
ROAD_CLASSES = ["motorway", "trunk", "primary"]
QUIET_NIGHTLIFE = ["bar", "pub", "dance_club", "cocktail_bar", "brewery"]
AIRPORTS = ["airport"]

LAND_USE = {"subtypes": ["park", "protected"], "recreation": ["playground", "pitch", "recreation_ground", "track"], "managed": ["grass"], "entertainment": ["zoo"]}
LAND = {"subtypes": ["forest", "grass"], "sand": ["beach"]}
#: (subtype, class or any)
FULL_WEIGHT = [("park", None), ("protected", None), ("entertainment", "zoo"), ("recreation", "playground")]
REDUCED_WEIGHT = [("recreation", "pitch"), ("recreation", "track"), ("recreation", "recreation_ground"), ("sand", "beach")]
REDUCED_WEIGHT_IF_LARGE = [("managed", "grass"), ("grass", None), ("forest", None)]
REDUCED_VALUE, MIN_AREA_M2 = 0.4, 2000

HIDDEN_FACTS = [
    "life_coach", "health_coaching", "nutrition_service", "weight_loss_center", "image_consultant", "food_consultant", "veterinarian",
    "pet_groomer", "pet_boarding", "pet_sitting", "dog_walker", "dog_trainer", "animal_shelter", "animal_or_pet_service", "horse_boarding",
    "pet_breeder", "pet_adoption", "animal_rescue_service", "food_delivery_service", "pizza_delivery_service",
]
FACTS = 12

FAR_KM = 15.0
PAGE_BUDGET = int(20_000 * 0.8) - 250
PEERS = 4
COHORT, CITY_MIN, CITY_MAX, INDEPENDENT_SHARE = 200, 12, 25, 0.70
DEDUPE_CELL_DEG, DEDUPE_M, MERGED_CONFIDENCE, SINGLE_CONFIDENCE = 0.0003, 25.0, 70.0, 100.0

REASONS = {"high": 75.0, "good": 70.0, "low_confidence": 60.0, "quiet": 80.0, "busy": 40.0, "close_transit_m": 250.0, "few_facts": 3}
LEADS = {
    "walkability_density": "walking to everyday places",
    "transit_access": "transit access",
    "food_essentials": "restaurants and everyday essentials",
    "family_convenience": "family convenience",
}
