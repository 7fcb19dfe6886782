"""Recorded publication decisions and the sets that must agree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources.versions import Table

STATUSES = ["draft", "noindex", "indexable", "retired"]
PAGE_TYPES = ["hotel", "city", "static"]


def latest(decisions: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key: what an upsert leaves. Partial maxima are combined before the shuffle."""
    return decisions.groupBy(*key).agg(F.max_by(F.struct(*decisions.columns), F.struct(at, tie)).alias("row")).select("row.*")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """stored with new rows in place of those with their key; of equal times the new row wins."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, key, at, "__new").drop("__new")


def refusal(page_type: Column, status: Column, reason: Column, name: Column, accommodation_type: Column, latin: Column) -> Column:
    """Why a decision may not be recorded; null where it may."""
    hotel = (page_type == "hotel") & (status == "indexable")
    return (
        F.when(~page_type.isin(PAGE_TYPES) | page_type.isNull(), "unknown page type")
        .when(~status.isin(STATUSES) | status.isNull(), "unknown status")
        .when(reason.isNull() | (F.trim(reason) == ""), "no reason")
        .when(hotel & scoring.numeric_name(name), "numeric name")
        .when(hotel & (accommodation_type != "hotel"), "not a hotel")
        .when(hotel & ~latin, "no readable name")
    )


def seed(hotels: DataFrame, cohort: DataFrame, recorded: DataFrame) -> DataFrame:
    """id, status, reason: cohort members are drafts, doubtful records drafts too, others noindex; recorded ids that vanished retire."""
    at = Window.partitionBy("city_id", "lat", "lon")
    h = hotels.select("id", "name", (F.count(F.lit(1)).over(at) > 1).alias("coincident"))
    h = h.join(cohort.select("id", F.lit(True).alias("chosen")), "id", "left")
    reason = F.when(F.col("chosen"), "cohort").when(scoring.numeric_name(F.col("name")), "numeric name").when(F.col("coincident"), "coincident")
    kept = h.select("id", F.when(reason.isNotNull(), "draft").otherwise("noindex").alias("status"), F.coalesce(reason, F.lit("default")).alias("reason"))
    gone = recorded.select("id").distinct().join(hotels.select("id"), "id", "left_anti")
    return kept.union(gone.select("id", F.lit("retired"), F.lit("vanished")))


def set_difference(built: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows that one set has and the other lacks; empty when they agree."""
    extra = built.select(column).distinct().exceptAll(wanted.select(column).distinct()).withColumn("problem", F.lit("not wanted"))
    missing = wanted.select(column).distinct().exceptAll(built.select(column).distinct()).withColumn("problem", F.lit("missing"))
    return extra.union(missing)


#: Entries of one sitemap, by the sitemap protocol.
SITEMAP_URLS = 50_000


def urlset(paths: DataFrame, base: str, most: int = SITEMAP_URLS) -> DataFrame:
    """city_id, part, xml: the sitemaps of each city, of at most ``most`` paths each, in order; ``sitemap_index`` lists them."""
    in_city = F.row_number().over(Window.partitionBy("city_id").orderBy("path")) - 1
    d = paths.select("city_id", "path", F.floor(in_city / F.lit(most)).alias("part"))
    loc = F.concat(F.lit("<url><loc>"), F.lit(base), F.col("path"), F.lit("</loc></url>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", loc.alias("loc")))), lambda s: s["loc"]), "")
    return d.groupBy("city_id", "part").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>")).alias("xml"))


def sitemap_index(urlsets: DataFrame, base: str) -> DataFrame:
    """xml: one index of all sitemaps, a line for each city and part: a few rows whatever the pages."""
    loc = F.concat(F.lit("<sitemap><loc>"), F.lit(base), F.lit("/sitemap-"), F.col("city_id"), F.lit("-"), F.col("part").cast("string"), F.lit(".xml</loc></sitemap>"))
    listed = F.array_sort(F.collect_list(F.struct("city_id", "part", loc.alias("loc"))))
    body = F.array_join(F.transform(listed, lambda s: s["loc"]), "")
    return urlsets.agg(F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</sitemapindex>")).alias("xml"))


def listed(decisions: DataFrame, status: str, page_type: str | None = None) -> DataFrame:
    """The newest decisions that have a status, of one page type or of all."""
    d = decisions.where(F.col("status") == status)
    return d if page_type is None else d.where(F.col("page_type") == page_type)


class DecisionError(ValueError):
    """A decision that may not be recorded."""


class Store:
    """Decisions on pages in a folder that all readers share.

    Every decision is a row that is added, never changed; the newest row of a page is what holds. Rows carry the number of the commit that
    added them, so that they are ordered as they were recorded, whatever clocks say. ``compact`` keeps the newest rows only; decisions that are
    recorded meanwhile stay beside them.
    """

    SCHEMA = "page_type string, page_id string, status string, reason string, decided_by string, decided_at timestamp, score_version string, seq long"
    KEY = ["page_type", "page_id"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Table(spark, path)

    def generation(self) -> int:
        """How often the store was compacted."""
        return (self.log.latest()[1] or {}).get("generation", 0)

    def record(self, decisions: DataFrame, names: DataFrame | None = None) -> None:
        """Add decisions(page_type, page_id, status, reason, decided_by, score_version); names(page_id, name, accommodation_type, readable)
        of hotels. One that may not be recorded stops them all."""
        d = decisions if names is None else decisions.join(names, "page_id", "left")
        column = lambda c, kind: F.col(c) if c in d.columns else F.lit(None).cast(kind)
        name, kind = column("name", "string"), column("accommodation_type", "string")
        readable = F.coalesce(column("readable", "boolean"), F.lit(False))
        hotel = (F.col("page_type") == "hotel") & (F.col("status") != "retired")
        marked = F.when(hotel, text.listed(name, F.col("page_id")))
        why = F.coalesce(marked, refusal(F.col("page_type"), F.col("status"), F.col("reason"), name, F.coalesce(kind, F.lit("unknown")), readable))
        bad = d.select("page_type", "page_id", why.alias("why")).where("why is not null").limit(5).collect()
        if bad:
            raise DecisionError("; ".join(f"{r.page_type} {r.page_id}: {r.why}" for r in bad))
        rows = d.select(*self.KEY, "status", "reason", "decided_by", F.current_timestamp().alias("decided_at"), column("score_version", "string").alias("score_version"))
        self.log.append(lambda number: rows.withColumn("seq", F.lit(number).cast("long")))

    def set_status(self, page_type: str, page_id: str, status: str, reason: str, decided_by: str, *, score_version: str | None = None, name: str | None = None, accommodation_type: str | None = None, readable: bool = False) -> None:
        one = self.spark.createDataFrame([(page_type, page_id, status, reason, decided_by, score_version, name, accommodation_type, readable)], "page_type string, page_id string, status string, reason string, decided_by string, score_version string, name string, accommodation_type string, readable boolean")
        self.record(one)

    def current(self) -> DataFrame:
        """The decision that holds for each page."""
        if not self.log.exists():
            return self.spark.createDataFrame([], self.SCHEMA).drop("seq")
        return latest(self.log.read(), self.KEY, "seq", "decided_at").drop("seq")

    def get_status(self, page_type: str, page_id: str) -> dict | None:
        found = self.current().where((F.col("page_type") == page_type) & (F.col("page_id") == page_id)).collect()
        return found[0].asDict() if found else None

    def is_indexable(self, page_type: str, page_id: str) -> bool:
        found = self.get_status(page_type, page_id)
        return found is not None and found["status"] == "indexable"

    def list_by_status(self, status: str, page_type: str | None = None) -> DataFrame:
        return listed(self.current(), status, page_type)

    def compact(self, keep: int = 2) -> None:
        """Keep only the rows that hold; the newest ``keep`` versions of the log stay for readers."""
        self.log.compact(lambda rows: latest(rows, self.KEY, "seq", "decided_at"))
        self.log.expire(keep)
