"""City configuration: the built-in cities, or a YAML or JSON file with the same fields, checked on load."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import cos, pi, radians

from pyspark.sql import DataFrame, SparkSession

from . import constants as C


class ConfigError(ValueError):
    """A configuration that must not be used."""


@dataclass(frozen=True)
class City:
    id: str
    name: str
    country: str
    lat: float
    lon: float
    box: tuple[float, float, float, float]
    expected_region: str | None = None

    def __post_init__(self) -> None:
        minx, miny, maxx, maxy = self.box
        if not (-180 <= minx < maxx <= 180 and -90 <= miny < maxy <= 90):
            raise ConfigError(f"{self.id}: the box {self.box} is not a box")
        if not (minx <= self.lon <= maxx and miny <= self.lat <= maxy):
            raise ConfigError(f"{self.id}: the centre is outside the box")

    @property
    def metres_x(self) -> float:
        """Metres for each degree of longitude in the city's equirectangular projection."""
        return C.EARTH_RADIUS_PLANAR_M * cos(radians(self.lat)) * pi / 180

    def margin(self, radius_m: float) -> tuple[float, float]:
        """Half-widths in degrees (lat, lon) that enclose a radius for certain."""
        d = radius_m * C.MARGIN_FACTOR / C.METRES_PER_DEGREE
        return d, d / max(cos(radians(self.lat)), 0.01)


METRES_Y = C.EARTH_RADIUS_PLANAR_M * pi / 180


def builtin() -> dict[str, City]:
    return {i: City(i, name, country, lat, lon, box, region) for i, name, country, (lat, lon), box, region in C.CITIES}


def read_file(path: str):
    """The content of a JSON file, or of a YAML file by any other name."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def load(path: str | None = None) -> dict[str, City]:
    """Cities by id. The file holds ``cities``: id, name, country, center {lat, lon}, bbox {minx, miny, maxx, maxy}, expected_region."""
    if path is None:
        return builtin()
    data = read_file(path)
    if not isinstance(data, dict) or not isinstance(data.get("cities"), list):
        raise ConfigError(f"{path}: no list of cities")
    try:
        found = [
            City(c["id"], c["name"], c["country"], float(c["center"]["lat"]), float(c["center"]["lon"]), tuple(float(c["bbox"][k]) for k in ("minx", "miny", "maxx", "maxy")), c.get("expected_region"))
            for c in data["cities"]
        ]
    except (KeyError, TypeError) as e:
        raise ConfigError(f"{path}: a city lacks {e}") from e
    if len({c.id for c in found}) < len(found):
        raise ConfigError(f"{path}: two cities have one id")
    return {c.id: c for c in found}


def check_weights(values: dict | None = None) -> None:
    """Persona and confidence weights sum to 1."""
    v = lambda n: (values or {}).get(n, getattr(C, n))
    for name, weights in [*v("PERSONAS").items(), ("confidence", v("CONFIDENCE_WEIGHTS"))]:
        if abs(sum(weights.values()) - 1) > 1e-9:
            raise ConfigError(f"the weights of {name} sum to {sum(weights.values())}")


def _numbers(found: dict, names: list[str], path: str, what: str) -> dict[str, float]:
    if not isinstance(found, dict) or set(found) != set(names) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0 for v in found.values()):
        raise ConfigError(f"{path}: {what} must have a positive number for each of {', '.join(names)}")
    return dict(found)


def weights_file(path: str) -> dict:
    """A file of scoring weights -> values of ``constants`` by name. What the file leaves out stays as it is; what it has is checked.

    Fields: score_version, decay_scale_m, hybrid_absolute_weight, absolute_saturation, quietness {start, penalties {weight, scale_m}},
    transit {multi_mode_bonus, max_bonus_modes}, confidence {weights, city_sample_target_n, default_place_confidence}, personas.
    """
    data, out = read_file(path), {}
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: no fields")
    try:
        if "score_version" in data:
            out["SCORE_VERSION"] = str(data["score_version"])
        if "decay_scale_m" in data:
            out["DECAY_M"] = _numbers(data["decay_scale_m"], list(C.DECAY_M), path, "decay_scale_m")
        if "absolute_saturation" in data:
            out["SATURATION"] = _numbers(data["absolute_saturation"], list(C.SATURATION), path, "absolute_saturation")
        if "hybrid_absolute_weight" in data:
            out["ABSOLUTE_WEIGHT"] = float(data["hybrid_absolute_weight"])
            if not 0 <= out["ABSOLUTE_WEIGHT"] <= 1:
                raise ConfigError(f"{path}: hybrid_absolute_weight must lie between 0 and 1")
        if (q := data.get("quietness")) is not None:
            out["QUIET_START"] = q.get("start", C.QUIET_START)
            if "penalties" in q:
                if set(q["penalties"]) != set(C.PENALTIES):
                    raise ConfigError(f"{path}: penalties must be {', '.join(C.PENALTIES)}")
                out["PENALTIES"] = {k: (q["penalties"][k]["weight"], q["penalties"][k]["scale_m"], C.PENALTIES[k][2]) for k in C.PENALTIES}
        if (t := data.get("transit")) is not None:
            out |= {"TRANSIT_BONUS": t["multi_mode_bonus"], "TRANSIT_BONUS_MODES": t["max_bonus_modes"]}
        if (c := data.get("confidence")) is not None:
            out |= {"CONFIDENCE_WEIGHTS": _numbers(c["weights"], list(C.CONFIDENCE_WEIGHTS), path, "confidence weights"), "CITY_SAMPLE_TARGET": c["city_sample_target_n"], "DEFAULT_PLACE_CONFIDENCE": c["default_place_confidence"]}
        if "personas" in data:
            if any(set(w) != set(C.DIMENSIONS) for w in data["personas"].values()) or "balanced" not in data["personas"]:
                raise ConfigError(f"{path}: each persona needs the six dimensions, and balanced must be there")
            out["PERSONAS"] = {n: {d: float(w[d]) for d in C.DIMENSIONS} for n, w in data["personas"].items()}
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigError(f"{path}: {e!r}") from e
    check_weights(out)
    return out


def taxonomy_file(path: str) -> dict:
    """A file of place kinds -> values of ``constants`` by name.

    Fields: hotel_types {included, excluded}, dimensions {radius_m, categories or hierarchies; land_use, land, land_weights and display_only_categories of
    family_convenience; radii, road_classes, nightlife_categories and airport_categories of quietness_proxy}, nearby_facts_display_exclude. A leaf may be
    a hotel type or an excluded one, and displayed or counted, not both.
    """
    data, out = read_file(path), {}
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: no fields")
    try:
        if (t := data.get("hotel_types")) is not None:
            out |= {"HOTEL_TYPES": list(t["included"]), "EXCLUDED_TYPES": list(t["excluded"])}
        found = data.get("dimensions") or {}
        if unknown := set(found) - set(C.DIMENSIONS):
            raise ConfigError(f"{path}: unknown dimensions {', '.join(sorted(unknown))}")
        for name, field_ in (("CATEGORIES", "categories"), ("FAMILIES", "hierarchies")):
            out[name] = {**getattr(C, name), **{d: list(v[field_]) for d, v in found.items() if field_ in v}}
        out["RADIUS_M"] = {**C.RADIUS_M, **{d: v["radius_m"] for d, v in found.items() if "radius_m" in v}}
        f = found.get("family_convenience", {})
        if "display_only_categories" in f:
            out["DISPLAY_ONLY"] = list(f["display_only_categories"])
        if (u := f.get("land_use")) is not None:
            out["LAND_USE"] = {"subtypes": u["subtypes"], "recreation": u["recreation_classes"], "managed": u["managed_classes"], "entertainment": u["entertainment_classes"]}
        if (u := f.get("land")) is not None:
            out["LAND"] = {"subtypes": u["subtypes"], "sand": u["sand_classes"]}
        if (w := f.get("land_weights")) is not None:
            kinds = lambda k: [(x["subtype"], x.get("class")) for x in w[k]]
            out |= {"FULL_WEIGHT": kinds("full_weight"), "REDUCED_WEIGHT": kinds("reduced_weight"), "REDUCED_WEIGHT_IF_LARGE": kinds("reduced_weight_min_area"), "REDUCED_VALUE": w["reduced_weight_value"], "MIN_AREA_M2": w["min_area_m2"]}
        if (q := found.get("quietness_proxy")) is not None:
            out["PENALTIES"] = {k: (*p[:2], q.get(f"{k}_radius_m", p[2])) for k, p in C.PENALTIES.items()}
            out |= {n: list(q[k]) for n, k in (("ROAD_CLASSES", "road_classes"), ("QUIET_NIGHTLIFE", "nightlife_categories"), ("AIRPORTS", "airport_categories")) if k in q}
        if "nearby_facts_display_exclude" in data:
            out["HIDDEN_FACTS"] = list(data["nearby_facts_display_exclude"])
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigError(f"{path}: {e!r}") from e
    check_disjoint(out)
    return out


def check_disjoint(values: dict | None = None) -> None:
    """Sets of the taxonomy that must not share a name."""
    v = lambda n: (values or {}).get(n, getattr(C, n))
    counted = {leaf for leaves in v("CATEGORIES").values() for leaf in leaves}
    pairs = [("hotel types", v("HOTEL_TYPES"), "excluded types", v("EXCLUDED_TYPES")), ("counted leaves", counted, "leaves for display only", v("DISPLAY_ONLY"))]
    weights = [[tuple(k) for k in v(n)] for n in ("FULL_WEIGHT", "REDUCED_WEIGHT", "REDUCED_WEIGHT_IF_LARGE")]
    pairs += [("kinds of full weight", weights[0], "kinds of reduced weight", weights[1] + weights[2])]
    for a, x, b, y in pairs:
        if both := set(x) & set(y):
            raise ConfigError(f"{a} and {b} share {sorted(map(str, both))}")


@contextmanager
def using(*values: dict) -> Iterator[None]:
    """Plans that are made meanwhile use these values of ``constants``. Penalties keep weights and scales of one file and radii of the other."""
    merged: dict = {}
    for v in values:
        for name, x in v.items():
            if name == "PENALTIES":
                now = merged.get(name, C.PENALTIES)
                x = {k: tuple(b if b != a else c for a, b, c in zip(C.PENALTIES[k], x[k], now[k])) for k in x}
            merged[name] = x
    before = {n: getattr(C, n) for n in merged}
    for n, x in merged.items():
        setattr(C, n, x)
    try:
        yield
    finally:
        for n, x in before.items():
            setattr(C, n, x)


CITY_SCHEMA = "city_id string, city_name string, city_country string, expected_region string, center_lat double, center_lon double, metres_x double, minx double, miny double, maxx double, maxy double"


def city_frame(spark: SparkSession, cities: dict[str, City] | None = None) -> DataFrame:
    """One row for each city: a few rows whatever the data, so a join broadcasts them."""
    rows = [(c.id, c.name, c.country, c.expected_region, c.lat, c.lon, c.metres_x, *c.box) for c in (cities or builtin()).values()]
    return spark.createDataFrame(rows, CITY_SCHEMA)
