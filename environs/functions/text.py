"""Names: normal forms, scripts, romanisation, rules, verdicts and reason codes.

Unicode normalisation has no built-in function: it runs as Arrow-batched pandas UDFs. All matching is Catalyst expressions.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import rules


def folded(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


_MARKED = regex.compile(r"(\p{Latin})\p{M}+")
_APOSTROPHES = regex.compile("['’‘ʼ`＇]")
_BREAK_ASCII, _BREAK = regex.compile(r"[\W_]+"), regex.compile(r"[\p{P}\p{Z}\s]+")


def plain(s: str | None) -> str | None:
    """Compatibility forms, lower case, marks gone from Latin letters only, no apostrophes, punctuation as single blanks."""
    if s is None:
        return None
    s = _MARKED.sub(r"\1", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s).lower()))
    s = _APOSTROPHES.sub("", unicodedata.normalize("NFC", s))
    return (_BREAK_ASCII if s.isascii() else _BREAK).sub(" ", s).strip()


@F.pandas_udf(T.StringType())
def ascii_fold(names: pd.Series) -> pd.Series:
    return names.map(folded, na_action="ignore")


@F.pandas_udf(T.StringType())
def rule_form(names: pd.Series) -> pd.Series:
    return names.map(plain, na_action="ignore")


def dedupe_form(name: Column) -> Column:
    """Folded, lower case, everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(name)), "[^a-z0-9]+", " "))


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "hotel").when(s.rlike("^[0-9]+$"), F.concat(F.lit("hotel-"), s)).otherwise(s)


def hotel_slug(name: Column, hotel_id: Column) -> Column:
    return F.concat(slugify(name), F.lit("-"), F.when(F.coalesce(hotel_id, F.lit("")) == "", "unknown").otherwise(F.right(hotel_id, F.lit(8))))


#: script -> class of its letters in Java's syntax; the long vowel mark is shared by both kana.
SCRIPTS = {
    "LATIN": r"\p{IsLatin}", "HIRAGANA": r"[\p{IsHiragana}ー]", "KATAKANA": r"\p{IsKatakana}", "CYRILLIC": r"\p{IsCyrillic}", "GREEK": r"\p{IsGreek}",
    "HANGUL": r"\p{IsHangul}", "THAI": r"\p{IsThai}", "ARABIC": r"\p{IsArabic}", "HEBREW": r"\p{IsHebrew}", "CJK": r"\p{IsHan}",
}
_KNOWN = "".join(c.strip("[]") for c in SCRIPTS.values())


def scripts(name: Column) -> Column:
    """The scripts of a name's letters, in the order of SCRIPTS, OTHER last."""
    n = F.coalesce(name, F.lit(""))
    found = [F.when(n.rlike(f"(?=\\p{{L}}){c}"), s) for s, c in SCRIPTS.items()]
    return F.array_compact(F.array(*found, F.when(n.rlike(rf"[\p{{L}}&&[^{_KNOWN}]]"), "OTHER")))


def readable_latin(name: Column) -> Column:
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return F.coalesce((letters >= 2) & (scripts(name) == F.array(F.lit("LATIN"))), F.lit(False))


def non_latin(name: Column) -> Column:
    return F.coalesce(name.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), F.lit(False))


def _kana() -> dict[str, str]:
    """Hiragana by rows of five; katakana lie 0x60 above."""
    table = {}
    for row, signs in [("", "あいうえお"), ("k", "かきくけこ"), ("g", "がぎぐげご"), ("s", "さしすせそ"), ("z", "ざじずぜぞ"), ("t", "たちつてと"), ("d", "だぢづでど"), ("n", "なにぬねの"), ("h", "はひふへほ"), ("b", "ばびぶべぼ"), ("p", "ぱぴぷぺぽ"), ("m", "まみむめも"), ("r", "らりるれろ")]:
        table |= {c: row + v for c, v in zip(signs, "aiueo")}
    table |= dict(zip("やゆよわをんぁぃぅぇぉゃゅょっ", ["ya", "yu", "yo", "wa", "wo", "n", "a", "i", "u", "e", "o", "ya", "yu", "yo", ""]))
    table |= dict(zip("しちつふじ", ["shi", "chi", "tsu", "fu", "ji"]))
    return table | {chr(ord(k) + 0x60): v for k, v in table.items()} | {"ー": "", "ヴ": "vu"}


_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", ["a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya"]))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ["a", "v", "g", "d", "e", "z", "i", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "y", "f", "ch", "ps", "o"]))


def _syllables() -> dict[str, str]:
    """Kana of several signs: a sign of the i-row with a small y-sign, and loan sounds with a small vowel."""
    one, out = _kana(), {}
    for c, v in list(one.items()):
        if v.endswith("i") and len(v) > 1 and not ("\u30a0" <= c <= "\u30ff"):
            stem = v[:-1]
            for small, vowel in zip("ゃゅょ", "auo"):
                out[c + small] = stem + vowel if stem in ("sh", "ch", "j") else f"{stem}y{vowel}"
    for c, stem in {"ふ": "f", "て": "t", "で": "d", "う": "w"}.items():
        out |= {c + small: stem + vowel for small, vowel in zip("ぁぃぇぉ", "aieo")}
    out |= {"しぇ": "she", "じぇ": "je", "ちぇ": "che", "てゅ": "tyu", "でゅ": "dyu", "とぅ": "tu", "どぅ": "du"}
    out |= {"".join(chr(ord(x) + 0x60) for x in c): v for c, v in out.items()}
    out |= {"ヴ" + small: "v" + vowel for small, vowel in zip("ァィェォ", "aieo")}
    whole = one | out
    # a small tsu doubles the consonant that follows
    for c, v in whole.items():
        if v and v[0] not in "aiueo" and c not in "んン":
            out[("っ" if c[0] < "\u30a0" else "ッ") + c] = ("t" if v.startswith("ch") else v[0]) + v
    return out


#: Greek letters that are read together; a voiced pair at a word's beginning is one sound.
_GREEK_PAIRS = {"ου": "ou", "αι": "ai", "ει": "ei", "οι": "oi", "αυ": "af", "ευ": "ef", "γγ": "ng", "γκ": "gk", "γχ": "nch", "μπ": "mp", "ντ": "nt", "τσ": "ts", "τζ": "tz", "θ": "th"}
_GREEK_PAIRS |= {a + c: r + "v" + s for a, r in (("αυ", "a"), ("ευ", "e")) for c, s in zip("αεηιοωβγδζλμνρ", ["a", "e", "i", "i", "o", "o", "v", "g", "d", "z", "l", "m", "n", "r"])}
_GREEK_FIRST = {"μπ": "b", "ντ": "d", "γκ": "g"}
_LETTERS = _kana() | _CYRILLIC | _GREEK | _syllables() | _GREEK_PAIRS


def _trie() -> dict:
    """_LETTERS by their signs: each node has its branches, and under "" the reading of what leads there."""
    root: dict = {}
    for signs, reading in _LETTERS.items():
        node = root
        for c in signs:
            node = node.setdefault(c, {})
        node[""] = reading
    return root


_TRIE = _trie()


def longest_reading(s: str, at: int) -> tuple[int, str] | None:
    """How many signs from a place on have a common reading, as many as possible, and the reading."""
    node, best, k = _TRIE, None, at
    while k < len(s) and s[k] in node:
        node = node[s[k]]
        k += 1
        if "" in node:
            best = (k - at, node[""])
    return best


_LEADS, _VOWELS, _TAILS = (
    "g kk n d tt r m b pp s ss - j jj ch k t p h".split(),
    "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(),
    "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split(),
)


def _bare(ch: str) -> str:
    """A letter without its marks, unless the letter itself has a reading or is a syllable of Hangul."""
    return ch if ch.lower() in _TRIE or 0xAC00 <= ord(ch) <= 0xD7A3 else unicodedata.normalize("NFD", ch)[0]


def romanised(s: str | None) -> str | None:
    """Kana, Cyrillic, Greek and Hangul in Latin letters, the longest known group of signs first; None if a letter has no reading.

    Kana: contracted sounds, doubled consonants, long vowels by a second vowel. Greek: pairs of letters. An approximation of our own.
    """
    if s is None:
        return None
    signs = "".join(map(_bare, unicodedata.normalize("NFC", s)))
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in signs)
    out: list[str] = []
    i = 0
    while i < len(signs):
        ch, n = signs[i], 1
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            k = ord(ch) - 0xAC00
            got = "".join((_LEADS[k // 588], _VOWELS[k % 588 // 28], _TAILS[k % 28])).replace("-", "")
        elif ch == "ー":
            before = out[-1][-1:] if out else ""
            got = before if before in tuple("aiueo") else ""
        elif low[i : i + 2] in _GREEK_FIRST and (i == 0 or not low[i - 1].isalpha()):
            n, got = 2, _GREEK_FIRST[low[i : i + 2]]
            got = got.capitalize() if ch != low[i] else got
        elif found := longest_reading(low, i):
            n, got = found
            got = got.capitalize() if ch != low[i] else got
        elif ch.isascii() or not ch.isalpha():
            got = ch
        else:
            return None
        out.append(got)
        i += n
    return "".join(out)


@F.pandas_udf(T.StringType())
def romanise(names: pd.Series) -> pd.Series:
    return names.map(romanised, na_action="ignore")


NAMES_SCHEMA = "common map<string,string>, rules array<struct<variant:string,language:string,value:string,between:string,side:string,perspectives:string>>"


def source_latin(names_json: Column) -> Column:
    """The Latin alternative that the source itself gives: English first, then by language, then by value."""
    n = F.from_json(names_json, NAMES_SCHEMA)

    def candidate(language: Column, value: Column) -> Column:
        tongue = F.coalesce(language, F.lit(""))
        return F.struct(F.when(tongue.startswith("en"), 0).otherwise(1).alias("o"), tongue.alias("l"), F.trim(value).alias("v"))

    common = F.transform(F.filter(F.map_entries(F.coalesce(n.common, F.create_map().cast("map<string,string>"))), lambda e: readable_latin(e.value)), lambda e: candidate(e.key, e.value))
    unscoped = F.filter(
        F.coalesce(n.rules, F.array().cast("array<struct<variant:string,language:string,value:string,between:string,side:string,perspectives:string>>")),
        lambda r: r.variant.isin("common", "official") & r["between"].isNull() & r["side"].isNull() & r["perspectives"].isNull() & readable_latin(r.value),
    )
    return F.get(F.array_sort(F.concat(common, F.transform(unscoped, lambda r: candidate(r.language, r.value)))), 0).v


def present_name(name: Column, names_json: Column | None = None) -> Column:
    """struct(display_name, name_latin, name_method, name_index_eligible, name_display_version).

    What several steps need is worked out once and bound; only names that may need it are sent to Python, the others as null.
    """
    original = F.trim(F.coalesce(name, F.lit("")))
    given = F.lit(None).cast("string") if names_json is None else source_latin(names_json)
    found = F.struct(original.alias("original"), scripts(original).alias("scripts"), readable_latin(original).alias("readable"), given.alias("given"))
    known = F.array(*[F.lit(x) for x in ("LATIN", "HIRAGANA", "KATAKANA", "CYRILLIC", "GREEK", "HANGUL")])
    wanted = F.get(F.transform(F.array(found), lambda f: F.when(~f.readable & f.given.isNull() & (F.size(f.scripts) > 0) & (F.size(F.array_except(f.scripts, known)) == 0), f.original)), 0)

    def steps(f: Column) -> Column:
        method = (
            F.when(f.readable, "source_primary_latin").when(f.given.isNotNull(), "source_alternative_latin").when(f.approximate_readable, "transliteration_approximate").otherwise("original_only_unreliable_transliteration")
        )
        return F.struct(f.original.alias("original"), method.alias("method"), F.when(f.readable, f.original).when(f.given.isNotNull(), f.given).when(f.approximate_readable, f.approximate).alias("latin"))

    approximate = F.get(F.transform(F.array(romanise(wanted)), lambda x: F.struct(x.alias("text"), F.coalesce(readable_latin(x), F.lit(False)).alias("readable"))), 0)
    bound = F.struct(original.alias("original"), readable_latin(original).alias("readable"), given.alias("given"), approximate["text"].alias("approximate"), approximate["readable"].alias("approximate_readable"))
    chosen = F.get(F.transform(F.transform(F.array(bound), steps), lambda c: F.struct(
        F.when(c.latin.isNotNull() & (c.latin != c.original), F.concat(c.latin, F.lit(" ("), c.original, F.lit(")"))).otherwise(c.original).alias("display_name"),
        c.latin.alias("name_latin"), c.method.alias("name_method"), c.latin.isNotNull().alias("name_index_eligible"), F.lit(rules.NAME_VERSION).alias("name_display_version"),
    )), 0)
    return chosen


def bounded(terms: list[str]) -> str:
    """Any of the terms between word boundaries, in Unicode."""
    return r"(?U)(?<!\w)(?:" + "|".join(regex.escape(t, special_only=True) for t in terms) + r")(?!\w)"


def institution_evidence(form: Column, hotel_id: Column | None = None) -> Column:
    """array(struct(reason, language, term)) of the rules that a name in rule form meets. A reviewed name meets none; a quarantined id always does."""
    found = []
    for reason, language, match, terms in rules.INSTITUTIONS:
        pattern = bounded(terms) if match == "word" else "|".join(terms)
        term = F.regexp_extract(form, f"({pattern})", 1)
        found.append(F.when(term != "", F.struct(F.lit(reason).alias("reason"), F.lit(language).alias("language"), term.alias("term"))))
    hits = F.when(form.isin(rules.REVIEWED), F.array().cast("array<struct<reason:string,language:string,term:string>>")).otherwise(F.array_compact(F.array(*found)))
    if hotel_id is None:
        return hits
    held = F.array(F.struct(F.lit("quarantined").alias("reason"), F.lit("").alias("language"), hotel_id.alias("term")))
    return F.when(hotel_id.isin(rules.QUARANTINED), held).otherwise(F.coalesce(hits, F.array().cast("array<struct<reason:string,language:string,term:string>>")))


def brand_groups(form: Column) -> Column:
    """Groups whose brand a name in rule form carries; a property word before the brand exempts it."""
    found = []
    for group, match, terms in rules.BRANDS:
        if match == "full":
            hit = form.isin(terms)
        else:
            hit = form.rlike(bounded(terms) if match == "word" else "|".join(terms))
            for t in terms:
                before = F.trim(F.substring(form, F.lit(1), F.greatest(F.instr(form, t) - 1, F.lit(0))))
                hit = hit & ~((F.instr(form, t) > 1) & before.isin(rules.PROPERTY_PREFIX))
        found.append(F.when(hit, group))
    return F.array_compact(F.array(*found))


def listed(name: Column, hotel_id: Column | None = None) -> Column:
    """Why a name must never be published: an institution or a listed brand; null for any other, and for no name."""
    form = rule_form(F.coalesce(name, F.lit("")))
    none = F.array().cast("array<string>")
    return F.when(F.size(institution_evidence(form, hotel_id)) > 0, "institution").when(F.size(F.coalesce(brand_groups(form), none)) > 0, "listed brand")


def non_hotel(name: Column, hotel_id: Column) -> Column:
    """Whether a name tells of something that isn't lodging: rules first, then brands and lodging words allow, then markers deny."""
    form = rule_form(name)
    f = ascii_fold(name)
    denied = f.rlike(r"(?i)\b(" + "|".join(rules.NOT_HOTEL_TERMS) + r")\b") | f.rlike("(?i)" + rules.RISKY + r"(?!\.?\s*" + rules.STREET + r"\b)") | f.rlike("(?i)" + rules.COMPOUND)
    listed = (F.size(institution_evidence(form, hotel_id)) > 0) | (F.size(F.coalesce(brand_groups(form), F.array().cast("array<string>"))) > 0)
    allowed = f.rlike("(?i)" + rules.HOSPITALITY) | f.rlike("(?i)" + rules.LODGING)
    return F.when(listed, True).when(name.isNull(), False).when(allowed, False).otherwise(denied)


def accommodation(name: Column, brand: Column, leaf: Column) -> Column:
    """struct(accommodation_type, label, reason, accommodation_type_version): the first rule that holds."""
    form, operator, kind = rule_form(F.coalesce(name, F.lit(""))), rule_form(F.coalesce(brand, F.lit(""))), F.coalesce(leaf, F.lit(""))
    where = {"name": form, "operator": operator, "both": F.concat_ws(" ", form, operator), "leaf": kind}

    def result(pair: tuple[str, str]) -> Column:
        return F.struct(F.lit(pair[0]).alias("accommodation_type"), F.lit(rules.ACCOMMODATION_LABELS[pair[0]]).alias("label"), F.lit(pair[1]).alias("reason"), F.lit(rules.ACCOMMODATION_VERSION).alias("accommodation_type_version"))

    out = F.when((kind == "resort") & form.rlike(r"\bhotel\b"), result(rules.RESORT_HOTEL)).otherwise(result(rules.UNKNOWN))
    for tests in reversed(rules.ACCOMMODATION):
        holds = reduce(lambda a, b: a | b, [where[w].rlike(p) for _, _, w, p in tests])
        out = F.when(holds, result(tests[0][:2])).otherwise(out)
    return out


def verdict(scores: dict[str, Column]) -> Column:
    """A sentence of the two best lead dimensions, if they are decent, and of the quietness."""
    from .scoring import verdict_band

    leads = F.array(*[F.struct((-scores[d]).alias("s"), F.lit(i).alias("i"), scores[d].alias("score"), F.lit(label).alias("label")) for i, (d, label) in enumerate(C.LEADS.items())])
    best = F.slice(F.array_sort(leads), 1, 2)
    clauses = F.transform(F.filter(best, lambda b: b.score >= 50), lambda b: F.concat(F.lower(verdict_band(b.score)), F.lit(" for "), b.label))
    q = scores["quietness_proxy"]
    quiet = F.when(q >= 80, "quiet surroundings").when(q < 40, "busy surroundings").otherwise("moderate surrounding activity")
    sentence = F.concat_ws("; ", clauses, quiet)
    sentence = F.concat(F.upper(F.substring(sentence, 1, 1)), F.substring(sentence, 2, 10_000), F.lit("."))
    return F.when(F.size(clauses) == 0, F.concat(F.lit("Mixed surroundings; "), quiet, F.lit(" — see the full scores below."))).otherwise(sentence)


def reason_codes(scores: dict[str, Column], confidence: Column, facts: Column) -> Column:
    """facts: array of struct(category, distance_m). Codes in their fixed order."""
    r, q = C.REASONS, scores["quietness_proxy"]
    close = F.exists(facts, lambda f: f.category.isin(C.CATEGORIES["transit_access"]) & (f.distance_m <= r["close_transit_m"]))
    codes = [
        F.when(scores["food_essentials"] >= r["high"], "HIGH_RESTAURANT_DENSITY"),
        F.when(scores["transit_access"] >= r["good"], "GOOD_TRANSIT_ACCESS"),
        F.when(close, "VERY_CLOSE_TRANSIT"),
        F.when(q >= r["quiet"], "QUIET_SURROUNDINGS").when(q < r["busy"], "BUSY_SURROUNDINGS"),
        F.when(scores["nightlife_access"] >= r["good"], "ACTIVE_NIGHTLIFE"),
        F.when(scores["family_convenience"] >= r["good"], "FAMILY_FRIENDLY_SURROUNDINGS"),
        F.when(confidence < r["low_confidence"], "LOW_DATA_CONFIDENCE"),
        F.when(F.size(facts) < r["few_facts"], "LIMITED_NEARBY_DATA"),
    ]
    return F.array_compact(F.array(*codes))


@F.pandas_udf(T.StringType())
def pruned_json(texts: pd.Series, excluded: pd.Series) -> pd.Series:
    """JSON without the objects, at any depth, whose id or slug is in the row's list; facts and codes are kept as they are.

    Text that isn't JSON stays as it is. Keys keep their order.
    """

    def clean(x, gone: set):
        if isinstance(x, list):
            return [v for v in (clean(i, gone) for i in x) if v is not None]
        if not isinstance(x, dict):
            return x
        if x.get("id") in gone or x.get("slug") in gone:
            return None
        return {k: v if k in ("nearby_facts", "reason_codes") else clean(v, gone) for k, v in x.items()}

    def one(t: str | None, gone) -> str | None:
        try:
            return None if t is None else json.dumps(clean(json.loads(t), set(gone if gone is not None else ())), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return t

    return pd.Series([one(t, g) for t, g in zip(texts, excluded)], dtype="object")


@F.udtf(returnType=T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]))
class WktEdges:
    """SQL: lateral wkt_edges(wkt) gives the edges of all rings or lines."""

    def eval(self, wkt: str):
        for ring in re.findall(r"\(([^()]+)\)", wkt or ""):
            at = [tuple(map(float, p.split()[:2])) for p in ring.split(",")]
            yield from (a + b for a, b in zip(at, at[1:]))


def register(spark: SparkSession) -> None:
    """The UDFs and the table function by name, for SQL."""
    spark.udtf.register("wkt_edges", WktEdges)
    for name, f in (("ascii_fold", ascii_fold), ("rule_form", rule_form), ("romanise", romanise)):
        spark.udf.register(name, f)
