"""The five commands over a data folder: ingest, score, validate, report, webdata.

Layout: <root>/source/{place,segment,land_use,land} and <root>/etl/<release>/<table>/city_id=<city>/. Every command works on
all its cities in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .config import City, check_disjoint, check_weights, load
from .functions import geo, scoring, termrules, text
from .operators import dedupe, dimensions, export, publication, quality, ranking
from .sources import readers, sinks
from .storage import drop, stash


@dataclass
class Engine:
    spark: SparkSession
    root: str
    release: str
    cities: dict[str, City]
    rules: dict[str, termrules.RuleSet] = field(default_factory=dict)
    #: Files whose bytes decide results: their digests are kept beside those of the source.
    files: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, root: str, release: str, cities: str = "all", *, city_file: str | None = None, institutions: str | None = None, brands: str | None = None, more: tuple = ()) -> Engine:
        """city_file, institutions and brands are files in place of what is built in; weights and taxonomies are set by ``config.using``."""
        check_weights()
        check_disjoint()
        known = load(city_file)
        files = {n: termrules.load(p) for n, p in (("institutions", institutions), ("brands", brands)) if p}
        wanted = list(known) if cities == "all" else [c.strip() for c in cities.split(",")]
        unknown = [c for c in wanted if c not in known]
        if unknown:
            raise ValueError(f"unknown city: {', '.join(unknown)}")
        return cls(spark, root.rstrip("/"), release, {c: known[c] for c in wanted}, files, [p for p in (city_file, institutions, brands, *more) if p])

    def evidence(self, hotels: DataFrame) -> DataFrame:
        """hotels with an array ``evidence`` of what the rule files of this engine say against their names."""
        form, found = text.rule_form(F.coalesce("name", F.lit(""))), [termrules.evidence(self.spark, r, F.col("__form"), F.col("id")) for r in self.rules.values()]
        none = F.array().cast(termrules.EVIDENCE)
        return hotels.withColumn("__form", form).withColumn("evidence", F.concat(none, *found)).drop("__form")

    def path(self, table: str) -> str:
        return f"{self.root}/etl/{self.release}/{table}"

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.where(F.col("city_id").isin(list(self.cities))) if "city_id" in df.columns else df

    def ingest(self) -> dict:
        """Source tables -> hotels, pois, segments, green, and the counts of each."""
        source = {k: readers.read_table(self.spark, f"{self.root}/source/{k}", k) for k in readers.REQUIRED}
        raw = readers.extract_hotels(source["place"], self.cities)
        if self.rules:
            judged = stash(self.evidence(raw), "judged")
            raw = judged.where(F.size("evidence") == 0).drop("evidence")
            sinks.write_parquet(judged.where(F.size("evidence") > 0).select("id", "city_id", "name", "evidence"), self.path("withheld"), None)
        raw = raw.withColumn("form", text.dedupe_form(F.col("name")))
        kept = dedupe.canonical(dedupe.clusters(raw, dedupe.links(raw)))
        hotels = raw.drop("form").join(kept.select("id", "dedupe_confidence", "dedupe_method", "merged_from"), "id")
        kind = text.accommodation(F.col("name"), F.col("brand_name"), F.col("leaf"))
        hotels = hotels.withColumn("a", kind).select("*", "a.accommodation_type", F.col("a.label").alias("accommodation_type_label"), F.col("a.reason").alias("accommodation_type_reason")).drop("a")
        tables = {
            "hotels": hotels,
            "pois": readers.extract_pois(source["place"], self.cities),
            "green": readers.extract_green(source["land_use"], source["land"], self.cities),
            "segments": readers.extract_segments(source["segment"], self.cities),
        }
        counts, merged = {}, {"merged": F.sum(F.size("merged_from"))}
        for name, df in tables.items():
            found = sinks.write_parquet(df, self.path(name), **(merged if name == "hotels" else {}))
            counts |= {name: found["rows"]} | {k: v for k, v in found.items() if k != "rows"}
        counts["excluded"] = sinks.write_parquet(readers.excluded_hotels(source["place"], self.cities), self.path("excluded"), None)["rows"]  # there may be none
        sizes = [sinks.file_sizes(self.table(name)).select("city_id", F.lit(name).alias("tbl"), "files", "bytes") for name in tables if counts[name]]
        if sizes:
            sinks.write_parquet(reduce(DataFrame.union, sizes), self.path("sizes"), None)
        sinks.write_parquet(readers.digests(self.spark, *[f"{self.root}/source/{k}" for k in readers.REQUIRED], *self.files), self.path("inputs"), None)
        names = [r.name for r in self.table("excluded").orderBy("name", "id").limit(50).collect()]
        sinks.write_manifest(self.spark, counts | {"excluded_names": names, "release": self.release}, f"{self.path('manifest')}.json")
        return counts

    def score(self) -> dict:
        """hotel_scores and nearby_facts."""
        hotels, pois, green, segments = (self.table(t) for t in ("hotels", "pois", "green", "segments"))
        s = dimensions.hotel_scores(hotels, pois, green, segments, hotels.select("id", "dedupe_confidence"), self.release)
        sinks.write_parquet(s, self.path("hotel_scores"))
        sinks.write_parquet(dimensions.nearby_facts(hotels, pois), self.path("nearby_facts"))
        got = self.table("hotel_scores").agg(F.count(F.lit(1)).alias("n"), F.median("confidence").alias("c"), F.avg("balanced_score").alias("b")).first()
        return {"hotels_scored": got.n, "median_confidence": got.c, "mean_balanced_score": got.b, "score_version": C.SCORE_VERSION}

    def validate(self) -> DataFrame:
        """Baselines by city, after the checks that stop a publication."""
        hotels, scores = self.table("hotels"), self.table("hotel_scores")
        quality.require_unlisted(hotels)
        quality.require(quality.hard_checks(hotels, scores))
        base = quality.baseline(scores).join(quality.soft_scan(hotels).drop("n_hotels"), "city_id")
        more = quality.scans(hotels, scores.withColumnRenamed("hotel_id", "id")).drop("n_hotels")
        sinks.write_parquet(base.join(more, "city_id"), self.path("baseline"), None)
        return self.table("baseline")

    def report(self) -> str:
        """A Markdown report: a few rows for each city."""
        base = self.table("baseline").orderBy("city_id").collect()
        dims = [f"{d}_median" for d in C.DIMENSIONS]
        parts = [f"# Data report, release {self.release}", sinks.table(["city", "hotels", "blank names", "numeric names", "other country"], [(r.city_id, r.n_hotels, r.n_blank, r.n_numeric, r.n_country) for r in base])]
        parts.append(sinks.table(["city", *C.DIMENSIONS], [(r.city_id, *[r[d] for d in dims]) for r in base]))
        scans = ["n_low_confidence", "n_all_zero", "n_coincident", "n_missing_name", "n_numeric_name", "n_far_from_center", "n_locality_mismatch", "n_excluded_type", "median_confidence"]
        parts.append("## Scans\n\n" + sinks.table(["city", *scans], [(r.city_id, *[r[c] for c in scans]) for r in base]))
        text_ = "\n\n".join(parts) + "\n"
        sinks.write_text(self.spark, text_, f"{self.path('report')}.md")
        return text_

    def webdata(self, indexable: DataFrame | None = None) -> int:
        """The search index, in shards, of all scored hotels; indexable(id) holds the recorded decisions."""
        hotels, scores = self.table("hotels"), self.table("hotel_scores")
        facts = self.table("nearby_facts").groupBy(F.col("hotel_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "category", "name", F.round("distance_m", 1).alias("distance_m")))).alias("facts"))
        if indexable is None:
            indexable = self.store().list_by_status("indexable", "hotel").select(F.col("page_id").alias("id"))
        d = hotels.join(scores.drop("city_id", "confidence").withColumnRenamed("hotel_id", "id"), "id").join(scores.select(F.col("hotel_id").alias("id"), F.col("confidence").alias("score_confidence")), "id").join(facts, "id", "left")
        d = d.withColumns({c: F.round(c, 1) for c in [*C.DIMENSIONS, "balanced_score", "score_confidence"]})
        none = F.array().cast("array<struct<rank:bigint,category:string,name:string,distance_m:double>>")
        d = d.withColumn("facts", F.coalesce("facts", none)).withColumn("p", text.present_name(F.col("name"), F.col("names_json")))
        d = d.join(indexable.select("id", F.lit(True).alias("decided")), "id", "left")
        public = F.coalesce("decided", F.lit(False)) & ~scoring.numeric_name(F.col("name")) & (F.col("accommodation_type") == "hotel") & F.col("p.name_index_eligible")
        km = geo.haversine_m(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon")) / 1000
        dims = {c: F.col(c) for c in C.DIMENSIONS}
        peer = ranking.peers(d.select("city_id", "id", F.col("balanced_score").alias("score"))).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "peer"))).alias("comparable"))
        d = d.join(peer, "id", "left").select(
            "id", "city_id", "city_name", "name", F.col("address_locality").alias("locality"), text.hotel_slug(F.col("name"), F.col("id")).alias("slug"), "p.display_name", "p.name_latin", "p.name_method", "accommodation_type", "accommodation_type_label",
            F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round(km, 1).alias("distance_from_center_km"), (F.round(km, 1) > C.FAR_KM).alias("far_from_center"),
            scoring.locality_mismatch(F.col("address_country"), F.col("address_region"), F.col("city_country"), F.col("expected_region"), F.col("city_name")).alias("locality_mismatch"),
            F.when(public, "indexable").otherwise("noindex").alias("publication_status"), F.struct(*C.DIMENSIONS).alias("scores"), "balanced_score", F.col("score_confidence").alias("confidence"),
            scoring.confidence_label(F.col("score_confidence")).alias("confidence_label"), text.verdict(dims).alias("verdict"), text.reason_codes(dims, F.col("score_confidence"), F.col("facts")).alias("reason_codes"), "facts",
            F.transform("comparable", lambda c: c.peer).alias("comparable"),
        )
        d = stash(d, "export")
        slugs = d.select(F.col("id").alias("peer"), F.col("slug").alias("to"))
        links = stash(d.select("slug", F.posexplode("comparable").alias("at", "peer")).join(slugs, "peer").select("slug", "at", "to"), "links")
        listed = links.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("listed"))  # PEERS at most
        d = d.drop("comparable").join(listed, "slug", "left").withColumn("comparable", F.transform("listed", lambda x: x.to)).drop("listed")
        subset = ranking.static_subset(d.select("city_id", "slug", F.col("publication_status").alias("status"), "confidence", "balanced_score"), links.select("slug", "to"))
        pages = stash(export.with_pages(d, subset), "pages")
        sinks.write_shards(export.search_index(pages), self.path("search"))
        pages.where("has_static_page").drop("has_static_page").repartition("city_id").write.mode("overwrite").partitionBy("city_id").json(self.path("hotel_pages"))
        scored = hotels.select("id", "name").join(scores.withColumnRenamed("hotel_id", "id"), "id")
        decided = self.store().list_by_status("indexable", "city").select(F.col("page_id").alias("city_id"))
        export.city_pages(scored, pages, quality.baseline(scores), decided).write.mode("overwrite").json(self.path("city_pages"))
        sinks.write_manifest(self.spark, {"release": self.release, "cities": list(self.cities), "personas": C.PERSONAS}, f"{self.path('meta')}.json")
        n = pages.count()
        drop(pages, links)
        return n

    def store(self) -> publication.Store:
        return publication.Store(self.spark, f"{self.root}/publication")

    def diff(self, old_release: str, moved: float = 15.0) -> str:
        """A Markdown report of what changed in the balanced score since another release, with the largest losses of each city."""
        old = self.spark.read.parquet(f"{self.root}/etl/{old_release}/hotel_scores").where(F.col("city_id").isin(list(self.cities)))
        both = self.table("hotel_scores").select(F.col("hotel_id").alias("id"), "city_id", F.col("balanced_score").alias("n"), *[F.col(d).alias(f"n_{d}") for d in C.DIMENSIONS])
        both = stash(both.join(old.select(F.col("hotel_id").alias("id"), F.col("balanced_score").alias("o"), *[F.col(d).alias(f"o_{d}") for d in C.DIMENSIONS]), "id"), "diff")
        delta = F.col("n") - F.col("o")
        changed = [F.count_if(F.abs(F.col(f"n_{d}") - F.col(f"o_{d}")) > 0.01).alias(d) for d in C.DIMENSIONS]
        counts = both.groupBy("city_id").agg(
            F.count(F.lit(1)).alias("hotels"), F.count_if(F.abs(delta) > 0.01).alias("changed"), F.count_if(F.abs(delta) >= moved).alias("moved"), F.round(F.avg(delta), 2).alias("mean"),
            F.round(F.min(delta), 2).alias("least"), F.round(F.max(delta), 2).alias("most"), *changed,
        )
        rows = counts.orderBy("city_id").collect()  # one a city
        named = both.withColumn("delta", F.round(delta, 6)).join(self.table("hotels").select("id", "name"), "id")
        drops = ranking.top(named.where("delta < 0"), 10, ["city_id"], [F.col("delta"), F.col("id")]).orderBy("city_id", "rank").collect()  # ten a city
        parts = [f"# Scores of {self.release} against {old_release}", sinks.table(["city", "hotels", "changed", f"by {moved:g} or more", "mean", "least", "most", *C.DIMENSIONS], [tuple(r) for r in rows])]
        parts.append("## Largest losses\n\n" + sinks.table(["city", "hotel", "old", "new", "change"], [(r.city_id, r.name, round(r.o, 1), round(r.n, 1), round(r.delta, 1)) for r in drops]))
        text_ = "\n\n".join(parts) + "\n"
        sinks.write_text(self.spark, text_, f"{self.path('diff')}.md")
        drop(both)
        return text_
