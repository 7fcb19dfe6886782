"""Rules, weights and taxonomies from files."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from environs import config
from environs import constants as C
from environs.functions import scoring, termrules, text


def plain_evidence(rules, form):
    """Each rule by a regular expression of its own."""
    out = []
    for r in rules.rules:
        either = "|".join(re.escape(t) for t in r.terms)
        pattern = {"word": rf"(?<!\w)(?:{either})(?!\w)", "substring": f"(?:{either})", "full": f"^(?:{either})$"}[r.match]
        if m := re.search(pattern, form):
            out.append((r.reason, m.group()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_automaton_is_all_expressions(seed):
    rng = random.Random(seed)
    syllables = ["ho", "tel", "ca", "fe", "é", "学", " ", "7"]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k)).strip() or "x"
    # one term of a rule isn't the beginning of another: an expression would then look for the first that fits with its bounds
    made = []
    for i in range(60):
        terms = sorted({text.plain(word(rng.randrange(1, 4))) for _ in range(5)} - {""}, key=len)
        terms = [t for k, t in enumerate(terms) if not any(t.startswith(s) for s in terms[:k])]
        made.append(termrules.Rule(f"r{i}", "", rng.choice(termrules.MATCHES), tuple(terms)))
    rules = termrules.RuleSet(made)
    found = rules.automaton()
    for _ in range(300):
        form = text.plain(word(rng.randrange(1, 12)))
        assert [(m[0], m[3]) for m in found.evidence(form)] == plain_evidence(rules, form)


def test_exceptions(spark):
    rules = termrules.parsed({
        "version": 1, "property_prefix_terms": ["hotel", "villa"],
        "rules": [{"reason": "programme", "group": "g", "language": "en", "match": "word", "terms": ["Bonvoy"], "allow_property_prefix": True}, {"reason": "school", "language": "fr", "match": "word", "terms": ["École"]}],
        "quarantined_records": [{"id": "h9", "slug": "s9", "reason": "held", "group": "q"}], "reviewed_hotels": [{"id": "h1", "slug": "s1", "name": "Ecole Inn", "allowed_reasons": ["school"]}],
    })
    rows = [("h1", "École Inn"), ("h2", "École Inn"), ("h3", "Maple Hotel Bonvoy"), ("h4", "The Hotel, Bonvoy"), ("h5", "Bonvoy"), ("s9", None), ("h9", "Grand"), ("h6", None), ("h7", "Ecoles")]
    d = spark.createDataFrame(rows, "id string, name string")
    got = {r.id: [(e.reason, e.group, e.term) for e in r.e] for r in d.select("id", termrules.evidence(spark, rules, text.rule_form(F.coalesce("name", F.lit(""))), F.col("id")).alias("e")).collect()}
    held = [("held", "q", "quarantined_id")]
    assert got == {"h1": [], "h2": [("school", None, "ecole")], "h3": [], "h4": [("programme", "g", "bonvoy")], "h5": [("programme", "g", "bonvoy")], "s9": held, "h9": held, "h6": [], "h7": []}


@pytest.mark.parametrize("wrong", [{}, [], {"version": 2, "rules": [1]}, {"version": 1, "rules": []}, {"version": 1, "rules": [{"reason": "r", "match": "like", "terms": ["a"]}]}, {"version": 1, "rules": [{"reason": "r", "match": "word", "terms": []}]}, {"version": 1, "rules": [{"reason": "r", "match": "word", "terms": ["..."]}]}, {"version": 1, "rules": [{"match": "word", "terms": ["a"]}]}])
def test_wrong_rules_stop(wrong, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps(wrong))
    with pytest.raises(termrules.RulesError):
        termrules.load(str(path))


def test_builtin_rules_as_a_set(spark):
    """The automaton says what the expressions of ``text`` say."""
    names = ["Aurora Academy", "University Inn", "Hôpital Canal", "東京大学", "Selina Canal", "Villa Selina", "my blueground flat", "Kasa", "Kasa Two", "Grand Hotel", None]
    d = spark.createDataFrame([(f"h{i}", n) for i, n in enumerate(names)] + [("h00000042", "Any")], "id string, name string").withColumn("f", text.rule_form(F.coalesce("name", F.lit(""))))
    a, b = termrules.evidence(spark, termrules.institutions(), F.col("f"), F.col("id")), termrules.evidence(spark, termrules.brands(), F.col("f"))
    rows = d.select("id", F.size(a).alias("a"), F.size(text.institution_evidence(F.col("f"), F.col("id"))).alias("x"), F.size(b).alias("b")).collect()
    assert all(r.a == r.x for r in rows) and sum(r.a for r in rows) == 4
    assert {r.id for r in rows if r.b} == {"h4", "h5", "h6", "h7"}


WEIGHTS = {"score_version": "9", "decay_scale_m": dict(C.DECAY_M, food_essentials=125), "hybrid_absolute_weight": 0.5, "quietness": {"start": 90, "penalties": {k: {"weight": w, "scale_m": s} for k, (w, s, _) in C.PENALTIES.items()}}, "personas": {"balanced": dict.fromkeys(C.DIMENSIONS, 1 / 6)}}
TAXONOMY = {"hotel_types": {"included": ["hotel"], "excluded": ["inn"]}, "dimensions": {"food_essentials": {"radius_m": 300, "categories": ["cafe"]}, "quietness_proxy": {"airport_radius_m": 9000, "road_classes": ["motorway"]}}}


@pytest.mark.parametrize("form", ["json", "yml"])
def test_weights_and_taxonomy_from_files(spark, tmp_path, form):
    w, t = tmp_path / f"w.{form}", tmp_path / f"t.{form}"
    w.write_text(json.dumps(WEIGHTS))
    t.write_text(json.dumps(TAXONOMY))
    before = (C.DECAY_M, C.PENALTIES)
    with config.using(config.weights_file(str(w)), config.taxonomy_file(str(t))):
        assert C.SCORE_VERSION == "9" and C.DECAY_M["food_essentials"] == 125 and C.RADIUS_M["food_essentials"] == 300 and C.CATEGORIES["food_essentials"] == ["cafe"]
        assert C.PENALTIES["airport"] == (30, 2500, 9000) and C.QUIET_START == 90 and list(C.PERSONAS) == ["balanced"] and C.HOTEL_TYPES == ["hotel"]
        v = spark.range(1).select(scoring.hybrid(F.lit(10.0), F.lit(20.0)).alias("h"), scoring.of_kind("food_essentials", F.lit("bakery"), F.array()).alias("k"), scoring.hotel_kind(F.lit("inn")).alias("i")).first()
        assert (v.h, v.k, v.i) == (15.0, False, False)
    assert (C.DECAY_M, C.PENALTIES) == before and C.SCORE_VERSION == "1.2.1"


@pytest.mark.parametrize(("load", "wrong"), [
    (config.weights_file, WEIGHTS | {"decay_scale_m": {"food_essentials": 1}}), (config.weights_file, WEIGHTS | {"hybrid_absolute_weight": 2}), (config.weights_file, WEIGHTS | {"personas": {"balanced": dict.fromkeys(C.DIMENSIONS, 1)}}),
    (config.weights_file, WEIGHTS | {"personas": {"x": {}}}), (config.weights_file, []), (config.weights_file, {"transit": {}}), (config.taxonomy_file, {"dimensions": {"noise": {}}}),
    (config.taxonomy_file, {"hotel_types": {"included": ["inn"], "excluded": ["inn"]}}), (config.taxonomy_file, {"dimensions": {"family_convenience": {"display_only_categories": ["aquarium"]}}}), (config.taxonomy_file, {"hotel_types": {}, "dimensions": 3}),
])
def test_wrong_files_stop(load, wrong, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps(wrong))
    with pytest.raises(config.ConfigError):
        load(str(path))


def test_builtin_sets_are_disjoint():
    config.check_disjoint()
    config.check_weights()
