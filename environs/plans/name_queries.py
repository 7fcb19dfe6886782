"""Names, rules, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import rules
from ..functions import scoring, termrules, text
from ..sources.atlas import Atlas
from .dimension_queries import FACTS_SQL, names
from .registry import query

FOLD = r"regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')"
#: The rule form of the atlas's names; Greek and kana have no punctuation there.
FORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[''’]', '', 'g'), '[ .,&@#-]+', ' ', 'g'))"


@query(f"select id, leaf from hotels where leaf in ({names(C.HOTEL_TYPES)})")
def hotel_type_filter(a: Atlas) -> DataFrame:
    return a.hotels.where(scoring.hotel_kind(F.col("leaf"))).select("id", "leaf")


@query(f"select poi_id, leaf in ({names(C.CATEGORIES['food_essentials'])}) as food, family in ({names(C.FAMILIES['walkability_density'])}) as walk from pois")
def dimension_predicate(a: Atlas) -> DataFrame:
    kinds = {n: scoring.of_kind(d, F.col("leaf"), F.col("hierarchy")) for n, d in (("food", "food_essentials"), ("walk", "walkability_density"))}
    return a.pois.select("poi_id", *[c.alias(n) for n, c in kinds.items()])


_ALL = sorted({x for d in ("food_essentials", "transit_access", "nightlife_access", "family_convenience") for x in C.CATEGORIES[d]} | set(C.AIRPORTS) | set(C.DISPLAY_ONLY))


@query(f"select poi_id from pois where leaf in ({names(_ALL)}) or family in ({names(C.FAMILIES['walkability_density'])})")
def lodging_exclusion(a: Atlas) -> DataFrame:
    return a.pois.where(scoring.poi_of_interest(F.col("leaf"), F.col("hierarchy"))).select("poi_id")


@query(
    """select green_id, subtype in ('park', 'protected') or (subtype = 'recreation' and class in ('playground', 'pitch', 'recreation_ground', 'track')) or (subtype = 'managed' and class = 'grass') or (subtype = 'entertainment' and class = 'zoo') as land_use,
  subtype in ('forest', 'grass') or (subtype = 'sand' and class = 'beach') as land from green"""
)
def green_predicates(a: Atlas) -> DataFrame:
    return a.green.select("green_id", *[scoring.green_source(s, F.col("subtype"), F.col("class")).alias(s) for s in ("land_use", "land")])


@query("select segment_id from segments where (subtype = 'road' and class in ('motorway', 'trunk', 'primary')) or subtype = 'rail'")
def road_rail_filter(a: Atlas) -> DataFrame:
    return a.segments.where(((F.col("subtype") == "road") & F.col("class").isin(C.ROAD_CLASSES)) | (F.col("subtype") == "rail")).select("segment_id")


@query("select id, coalesce(regexp_matches(trim(name), '^[0-9]+$'), false) as numeric_name, name is null or trim(name) = '' as blank from hotels")
def numeric_name_flag(a: Atlas) -> DataFrame:
    return a.hotels.select("id", scoring.numeric_name(F.col("name")).alias("numeric_name"), scoring.blank_name(F.col("name")).alias("blank"))


@query(f"select poi_id from pois where leaf not in ({names(C.HIDDEN_FACTS)})")
def deny_list_filter(a: Atlas) -> DataFrame:
    return a.pois.where(~F.col("leaf").isin(C.HIDDEN_FACTS)).select("poi_id")


@query("select id, name from hotels where name ilike '%HOTEL%'")
def ilike_filter(a: Atlas) -> DataFrame:
    return a.hotels.where(F.col("name").ilike("%HOTEL%")).select("id", "name")


@query("select city_id, id, name from hotels where contains(lower(concat_ws(' ', name, city_name)), 'grand a') order by id limit 8")
def search_contains(a: Atlas) -> DataFrame:
    """The first eight rows in index order whose name and city contain the text."""
    return a.hotels.where(F.lower(F.concat_ws(" ", "name", "city_name")).contains("grand a")).select("city_id", "id", "name").orderBy("id").limit(8)


@query("select id, right(id, 1) as bucket, city_id from hotels where right(id, 1) = '7' and id = 'h00000007'")
def shard_lookup(a: Atlas) -> DataFrame:
    """A point look-up: the bucket prunes the partition, the key the row."""
    return a.hotels.select("id", F.right(F.col("id"), F.lit(1)).alias("bucket"), "city_id").where((F.col("bucket") == "7") & (F.col("id") == "h00000007"))


@query("select id, 'x' || id as primary_name, id || '/' || leaf as first_address, 2::int as n_sources, null::varchar as second from hotels")
def nested_projection(a: Atlas) -> DataFrame:
    """Fields of structs, the first element of an array (null when there is none), and an array's length."""
    nested = a.hotels.select(
        "id",
        F.struct(F.concat(F.lit("x"), "id").alias("primary")).alias("names"),
        F.array(F.struct(F.concat("id", F.lit("/"), "leaf").alias("freeform"))).alias("addresses"),
        F.array(F.lit("a"), F.lit("b")).alias("sources"),
    )
    return nested.select("id", F.col("names.primary").alias("primary_name"), F.expr("try_element_at(addresses, 1).freeform").alias("first_address"), F.size("sources").alias("n_sources"), F.expr("try_element_at(addresses, 2).freeform").alias("second"))


@query("select id, '{\"name\":' || coalesce('\"' || name || '\"', 'null') || '}' as js from hotels")
def names_json(a: Atlas) -> DataFrame:
    return a.hotels.select("id", F.to_json(F.struct("name"), {"ignoreNullFields": "false"}).alias("js"))


@query("select id, name, city_id, 'local' as source_release, '1.2.1' as score_version from hotels")
def version_stamp(a: Atlas) -> DataFrame:
    kept = a.hotels.drop(*[c for c in a.hotels.columns if c not in ("id", "name", "city_id")])
    return kept.select("*", F.lit("local").alias("source_release"), F.lit(C.SCORE_VERSION).alias("score_version"))


_SLUG = f"regexp_replace(regexp_replace(lower({FOLD.format('coalesce(name, chr(0))')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"select id, case when s = '' then 'hotel' when regexp_matches(s, '^[0-9]+$') then 'hotel-' || s else s end || '-' || right(id, 8) as slug from (select id, {_SLUG} as s from hotels)".replace("chr(0)", "''"))
def slugify(a: Atlas) -> DataFrame:
    return a.hotels.select("id", text.hotel_slug(F.col("name"), F.col("id")).alias("slug"))


_SCRIPTS = [("LATIN", r"\p{Latin}"), ("HIRAGANA", r"[\p{Hiragana}ー]"), ("KATAKANA", r"\p{Katakana}"), ("CYRILLIC", r"\p{Cyrillic}"), ("GREEK", r"\p{Greek}"), ("CJK", r"\p{Han}")]
_FOUND = "list_filter([" + ", ".join(f"case when regexp_matches(coalesce(name, ''), '{p}') then '{s}' end" for s, p in _SCRIPTS) + "], lambda v: v is not null)"
_READABLE = "(length(regexp_replace(coalesce(name, ''), '[^\\p{L}]', '', 'g')) >= 2 and f = ['LATIN'])"


@query(f"select id, array_to_string({_FOUND}, ',') as scripts from hotels")
def script_class(a: Atlas) -> DataFrame:
    return a.hotels.select("id", F.array_join(text.scripts(F.col("name")), ",").alias("scripts"))


@query(f"select id, {_READABLE} as readable, len(list_filter(f, lambda v: v <> 'LATIN')) > 0 as non_latin from (select id, name, {_FOUND} as f from hotels)")
def latin_name(a: Atlas) -> DataFrame:
    return a.hotels.select("id", text.readable_latin(F.col("name")).alias("readable"), text.non_latin(F.col("name")).alias("non_latin"))


_ROMAN = "replace(replace(replace(trim(coalesce(name, '')), 'Отель', 'Otel'), 'Ξενία', 'Xenia'), 'ホテル', 'hoteru')"


@query(
    f"""select id, case when m = 'approx' then r || ' (' || o || ')' else o end as display_name, case m when 'approx' then r when 'latin' then o end as name_latin,
  case m when 'approx' then 'transliteration_approximate' when 'latin' then 'source_primary_latin' else 'original_only_unreliable_transliteration' end as name_method, m in ('approx', 'latin') as name_index_eligible
  from (select id, trim(coalesce(name, '')) as o, {_ROMAN} as r, case when {_READABLE} then 'latin' when len(f) > 0 and not list_contains(f, 'CJK') then 'approx' else 'none' end as m from (select id, name, {_FOUND} as f from hotels))"""
)
def present_name(a: Atlas) -> DataFrame:
    return a.hotels.select("id", text.present_name(F.col("name")).alias("p")).select("id", "p.display_name", "p.name_latin", "p.name_method", "p.name_index_eligible")


@query("select id, case when key % 3 = 0 then 'Able ' || id when key % 3 = 1 then 'Zed ' || id end as latin from hotels")
def source_latin(a: Atlas) -> DataFrame:
    """Alternatives given in JSON: English before others, historical and scoped names left out."""
    k = F.col("key")
    common = F.when(k % 3 == 0, F.create_map(F.lit("fr"), F.concat(F.lit("Aa "), "id"), F.lit("en"), F.concat(F.lit("Able "), "id")))
    variant = F.when(k % 3 == 1, "official").otherwise("short")
    rule = F.struct(variant.alias("variant"), F.lit("de").alias("language"), F.concat(F.lit("Zed "), "id").alias("value"), F.lit(None).cast("string").alias("between"))
    given = F.to_json(F.struct(common.alias("common"), F.array(rule).alias("rules")))
    return a.hotels.select("id", text.source_latin(given).alias("latin"))


@query(f"select id, trim(regexp_replace(lower({FOLD.format('name')}), '[^a-z0-9]+', ' ', 'g')) as form from hotels")
def name_norm(a: Atlas) -> DataFrame:
    return a.hotels.select("id", text.dedupe_form(F.col("name")).alias("form"))


@query(f"select id, {FORM.format('name')} as form from hotels where regexp_matches(name, '^[\\p{{Latin}}0-9 ]*$')")
def rule_form(a: Atlas) -> DataFrame:
    return a.hotels.where(F.col("name").rlike(r"^[\p{IsLatin}0-9 ]*$")).select("id", text.rule_form(F.col("name")).alias("form"))


@query(
    f"""select id, case when id in ({names(rules.QUARANTINED)}) then 'quarantined' when f is null then '' else concat_ws(',',
  nullif(case when regexp_matches(f, '\\b(school|academy|university|college|kindergarten)\\b') then 'school:' || regexp_extract(f, '\\b(school|academy|university|college|kindergarten)\\b', 1) end, ''),
  case when regexp_matches(f, '\\b(embassy|consulate|ministry)\\b') then 'government:' || regexp_extract(f, '\\b(embassy|consulate|ministry)\\b', 1) end) end as evidence
  from (select id, {FORM.format('name')} as f from hotels)"""
)
def rules_evidence(a: Atlas) -> DataFrame:
    hits = text.institution_evidence(text.rule_form(F.col("name")), F.col("id"))
    shown = F.transform(hits, lambda h: F.when(h.reason == "quarantined", h.reason).otherwise(F.concat_ws(":", h.reason, h.term)))
    return a.hotels.select("id", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("evidence"))


@query(f"select id, concat_ws(',', case when starts_with(f, 'selina ') then 'selina' end, case when starts_with(f, 'sonder ') then 'sonder' end, case when contains(f, 'blueground') then 'blueground' end) as groups from (select id, {FORM.format('name')} as f from hotels where name is not null)")
def brand_prefix(a: Atlas) -> DataFrame:
    return a.hotels.where("name is not null").select("id", F.array_join(text.brand_groups(text.rule_form(F.col("name"))), ",").alias("groups"))


_BAD = "'(?i)\\b(embassy|university|school|academy|hospital|consulate)\\b'"


@query(
    f"""select id, case when id in ({names(rules.QUARANTINED)}) then true when name is null then false when regexp_matches(f, {_BAD}) or regexp_matches(f, '(?i)\\b(selina|sonder)\\b') or contains(lower(f), 'blueground') then true
  when regexp_matches(f, '(?i)\\b(marriott|oyo)\\b') or regexp_matches(f, '(?i)\\b(hotel|inn|guest ?house|serviced apartments?|chateau)\\b') then false
  else (regexp_matches(f, '(?i)\\b(bank|church)\\b') and not regexp_matches(f, '(?i)\\b(bank|church) street')) or regexp_matches(f, '(?i)by ?design\\b') end as excluded
  from (select id, name, {FOLD.format('name')} as f from hotels)"""
)
def rejected_by_name(a: Atlas) -> DataFrame:
    return a.hotels.select("id", text.non_hotel(F.col("name"), F.col("id")).alias("excluded"))


def _accommodation_sql() -> str:
    cases = []
    for tests in rules.ACCOMMODATION:
        where = {"name": "f", "both": "concat_ws(' ', f, o)", "leaf": "leaf"}
        holds = " or ".join(f"regexp_matches({where[w]}, '{p}')" for _, _, w, p in tests)
        cases.append(f"when {holds} then '{tests[0][0]}|{tests[0][1]}'")
    return "case " + " ".join(cases) + f" when leaf = 'resort' and regexp_matches(f, '\\bhotel\\b') then '{'|'.join(rules.RESORT_HOTEL)}' else '{'|'.join(rules.UNKNOWN)}' end"


ACCOMMODATION_SQL = f"select id, split_part(r, '|', 1) as accommodation_type, split_part(r, '|', 2) as reason from (select id, {_accommodation_sql()} as r from (select id, leaf, {FORM.format(chr(39) * 2)} || {FORM.format('coalesce(name, chr(32))')} as f, lower(coalesce(brand_name, '')) as o from hotels))"


@query(ACCOMMODATION_SQL)
def accommodation_type(a: Atlas) -> DataFrame:
    d = a.hotels.select("id", text.accommodation(F.col("name"), F.col("brand_name"), F.col("leaf")).alias("a"))
    return d.select("id", "a.accommodation_type", "a.reason")


@query(
    """select id, case when address_country <> city_country then 'Address country (' || address_country || ') does not match ' || city_name || ' (' || city_country || ')'
  when address_region <> expected_region then 'Address region (' || address_region || ') does not match ' || city_name || ' (' || expected_region || ')' end as mismatch from hotels"""
)
def locality_mismatch(a: Atlas) -> DataFrame:
    m = scoring.locality_mismatch(F.col("address_country"), F.col("address_region"), F.col("city_country"), F.col("expected_region"), F.col("city_name"))
    return a.hotels.select("id", m.alias("mismatch"))


#: Scores by arithmetic for everything downstream of scoring: (old, new) versions.
def table_scores(a: Atlas, bump: int = 0) -> DataFrame:
    k = F.col("key")
    dims = [((k * (17 + 2 * i) + 31 * i + F.when(k % 7 == 0, bump).otherwise(0)) % 1001 / F.lit(10.0)).alias(d) for i, d in enumerate(C.DIMENSIONS)]
    d = a.hotels.select("*", *dims, ((k * 37 + 11) % 1001 / F.lit(10.0)).alias("score_confidence"))
    return d.withColumn("balanced_score", F.round(scoring.weighted(C.PERSONAS["balanced"]), 6))


def scores_sql(name: str, bump: int = 0) -> str:
    dims = ", ".join(f"((key * {17 + 2 * i} + {31 * i} + case when key % 7 = 0 then {bump} else 0 end) % 1001) / 10.0::double as {d}" for i, d in enumerate(C.DIMENSIONS))
    total = " + ".join(f"{w}::double * {d}" for d, w in C.PERSONAS["balanced"].items())
    return f"{name} as (select *, round({total}, 6) as balanced_score from (select *, {dims}, ((key * 37 + 11) % 1001) / 10.0::double as score_confidence from hotels))"


VERDICT_SQL = f"""leads as (select id, quietness_proxy as q, unnest([{', '.join(f"{{'s': -{d}, 'i': {i}, 'v': {d}, 'l': '{label}'}}" for i, (d, label) in enumerate(C.LEADS.items()))}]) as e from sc),
  best as (select id, q, e, row_number() over (partition by id order by e.s, e.i) as rn from leads),
  clauses as (select id, any_value(q) as q, string_agg(case when e.v >= 50 then case when e.v >= 80 then 'excellent' when e.v >= 65 then 'good' else 'decent' end || ' for ' || e.l end, '; ' order by rn) as c from best where rn <= 2 group by id),
  spoken as (select id, c, case when q >= 80 then 'quiet surroundings' when q < 40 then 'busy surroundings' else 'moderate surrounding activity' end as qs from clauses)"""


@query("select id, case when c is null then 'Mixed surroundings; ' || qs || ' — see the full scores below.' else upper(c[1]) || c[2:] || '; ' || qs || '.' end as verdict from spoken", scores_sql("sc") + ", " + VERDICT_SQL)
def verdict_text(a: Atlas) -> DataFrame:
    return table_scores(a).select("id", text.verdict({d: F.col(d) for d in C.DIMENSIONS}).alias("verdict"))


@query(
    """select id, concat_ws(',', case when food_essentials >= 75 then 'HIGH_RESTAURANT_DENSITY' end, case when transit_access >= 70 then 'GOOD_TRANSIT_ACCESS' end, case when coalesce(close, 0) > 0 then 'VERY_CLOSE_TRANSIT' end,
  case when quietness_proxy >= 80 then 'QUIET_SURROUNDINGS' when quietness_proxy < 40 then 'BUSY_SURROUNDINGS' end, case when nightlife_access >= 70 then 'ACTIVE_NIGHTLIFE' end, case when family_convenience >= 70 then 'FAMILY_FRIENDLY_SURROUNDINGS' end,
  case when score_confidence < 60 then 'LOW_DATA_CONFIDENCE' end, case when coalesce(n, 0) < 3 then 'LIMITED_NEARBY_DATA' end) as codes
  from sc left join (select hotel_id, count(*) as n, count(*) filter (where category in ('train_station', 'metro_station', 'light_rail_and_subway_station', 'bus_station', 'public_transit_facility_or_service') and distance_m <= 250) as close from facts group by 1) f on f.hotel_id = id""",
    scores_sql("sc") + ", " + FACTS_SQL,
)
def reason_codes(a: Atlas) -> DataFrame:
    from ..operators.dimensions import nearby_facts

    facts = nearby_facts(a.hotels, a.pois).groupBy(F.col("hotel_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "category", "distance_m"))).alias("facts"))
    none = F.array().cast("array<struct<rank:bigint,category:string,distance_m:double>>")
    d = table_scores(a).join(facts, "id", "left").withColumn("facts", F.coalesce("facts", none))
    return d.select("id", F.array_join(text.reason_codes({c: F.col(c) for c in C.DIMENSIONS}, F.col("score_confidence"), F.col("facts")), ",").alias("codes"))


@query("select id, case when balanced_score >= 75 then 'strong' when balanced_score >= 50 then 'fair' else 'weak' end as ui_band, case when quietness_proxy >= 80 then 'quiet' when quietness_proxy >= 40 then 'moderate' else 'busy' end as quiet_band from sc", scores_sql("sc"))
def score_bands(a: Atlas) -> DataFrame:
    return table_scores(a).select("id", scoring.band(F.col("balanced_score"), [(75, "strong"), (50, "fair")], "weak").alias("ui_band"), scoring.band(F.col("quietness_proxy"), [(80, "quiet"), (40, "moderate")], "busy").alias("quiet_band"))


@query("select poi_id, case when name <> upper(name) and name is not null then name || ' *' end as display_name from pois")
def fact_display(a: Atlas) -> DataFrame:
    """A display name only where it differs from the name."""
    shown = F.when(F.col("name") != F.upper("name"), F.concat("name", F.lit(" *"))).otherwise(F.col("name"))
    return a.pois.select("poi_id", F.when(shown != F.col("name"), shown).alias("display_name"))


@query("select id, sha256(coalesce(name, '')) as sha from hotels")
def sha_provenance(a: Atlas) -> DataFrame:
    return a.hotels.select("id", F.sha2(F.coalesce("name", F.lit("")), 256).alias("sha"))


@query("select page_id, n_titles, n_title_pages from (select page_id, len(regexp_extract_all(html, '<title>'))::bigint as n_titles, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) join (select regexp_extract(html, '<title>([^<]*)</title>', 1) as title, count(*) as n_title_pages from pages group by 1) using (title)", plain=True)
def html_title_unique(a: Atlas) -> DataFrame:
    p = a.table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<title>)"))).cast("long").alias("n_titles"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.join(p.groupBy("title").agg(F.count(F.lit(1)).alias("n_title_pages")), "title").select("page_id", "n_titles", "n_title_pages")


@query("select id, list_sort(list_filter(['a', case when key % 2 = 0 then 'b' end, case when key % 3 = 0 then 'c' end], lambda v: v is not null and v <> 'c')) as kept, key % 3 = 0 as overlaps from hotels")
def json_prune(a: Atlas) -> DataFrame:
    """Objects of a typed array that are excluded go; arrays are compared as sets."""
    k = F.col("key")
    tags = F.array_compact(F.array(F.lit("a"), F.when(k % 2 == 0, "b"), F.when(k % 3 == 0, "c")))
    return a.hotels.select("id", F.array_sort(F.filter(tags, lambda t: t != "c")).alias("kept"), F.arrays_overlap(tags, F.array(F.lit("c"))).alias("overlaps"))


_TERMS = """terms as (select distinct 'name' as reason, case when length(p_name) % 2 = 0 then 'word' else 'full' end as match, p_name as term from part
    union select distinct 'thing', 'substring', regexp_extract(p_name, '[a-z]+$') from part union select distinct 'kind', 'word', lower(p_type) from part),
  named as (select 2 * p_partkey as key, lower(p_type) || ' ' || p_name || case when p_partkey % 3 = 0 then 's' else '' end as form from part union all select 2 * p_partkey + 1, p_name from part),
  places as (select key, reason, match, term, case match when 'full' then case when form = term then 1 end when 'word' then nullif(strpos(' ' || form || ' ', ' ' || term || ' '), 0) else nullif(strpos(form, term), 0) end as place from named, terms),
  firsts as (select * from places where place is not null qualify row_number() over (partition by key, reason, match order by place, term) = 1)"""


@query("select n.key, coalesce(string_agg(reason || ':' || match || ':' || term, ',' order by reason, match), '') as evidence from named n left join firsts using (key) group by n.key", _TERMS)
def table_rules(a: Atlas) -> DataFrame:
    """Rules whose terms come from a table, all looked up in one pass over each name."""
    part = a.table("part")
    terms = part.select(F.lit("name").alias("reason"), F.when(F.length("p_name") % 2 == 0, "word").otherwise("full").alias("match"), F.col("p_name").alias("term"))
    terms = terms.union(part.select(F.lit("thing"), F.lit("substring"), F.regexp_extract("p_name", "[a-z]+$", 0))).union(part.select(F.lit("kind"), F.lit("word"), F.lower("p_type")))
    found = termrules.from_frame(terms.select("reason", F.col("match").alias("language"), "match", "term"))
    name = F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.when(F.col("p_partkey") % 3 == 0, "s").otherwise(""))
    named = part.select((2 * F.col("p_partkey")).alias("key"), name.alias("name")).union(part.select(2 * F.col("p_partkey") + 1, "p_name"))
    hits = termrules.evidence(a.spark, found, text.rule_form(F.col("name")))
    return named.select("key", F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h.reason, h.language, h.term)), ",").alias("evidence"))
