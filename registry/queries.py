"""Registered queries: name -> (spark, folder of the tables) -> DataFrame.

Every query runs over the whole of its tables. Doubles are rounded to six
decimals and integers widened, so that results compare across engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from registry import tables as R
from skewlens import configure, shared_folder
from skewlens import constants as K
from skewlens.functions import special
from skewlens.functions.dates import floor_days
from skewlens.functions.text import classify, contains_any, first_code
from skewlens.operators import category as cat
from skewlens.operators import counts as cnt
from skewlens.operators import features as feat
from skewlens.operators import joins
from skewlens.operators import persistence as per
from skewlens.operators import quality as qual
from skewlens.operators import representation as rep
from skewlens.operators import results as res
from skewlens.operators import trends as trd
from skewlens.operators import weapons as wpn
from skewlens.plans import audit, datasets, report
from skewlens.sources import baseline as src_baseline
from skewlens.sources import files, notices as src_notices
from skewlens.sources.tables import TableStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANALYSED = datetime(2001, 8, 3)

# Content topics looked for in whole documents.
TOPICS = [
    ("license", ["license", "copyright", "all rights reserved"]),
    ("contact", ["@", "http://", "https://", "e-mail"]),
    ("secret", ["password", "api_key", "token", "begin rsa"]),
    ("short words", ["gun", "cut", "bat"]),
]


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles, widen integers, print dates: a form that compares across engines."""
    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + 0.0
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema])


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        configure(spark)
        return tidy(fn(spark, sf))

    QUERIES[fn.__name__] = run
    return run


# --- representation against size: customers per nation ---------------------

def _nations(spark, sf):
    return rep.representation_from_counts(R.customers_per_nation(spark, sf), "unit")


@query
def nation_representation_test(spark, sf):
    """Flagship: chi-square of customers per nation against suppliers per nation."""
    return rep.chi_square(_nations(spark, sf))


@query
def nation_representation(spark, sf):
    return _nations(spark, sf)


@query
def nation_representation_summary(spark, sf):
    return rep.representation_summary(_nations(spark, sf))


# --- sources and sinks -----------------------------------------------------

def _payloads(spark, sf):
    """Notices as JSON pages, dates as text in several spellings, some unreadable."""
    n = R.raw_notices(spark, sf)
    key = F.expr("cast(substring(uid, 2) as bigint)")
    spelled = (
        F.when(F.pmod(key, F.lit(50)) == 0, F.lit("no date"))
        .when(F.pmod(key, F.lit(50)) == 1, F.date_format("publication_date", "MM/dd/yyyy"))
        .when(F.pmod(key, F.lit(50)) == 2, F.date_format("publication_date", "yyyy-MM-dd"))
        .otherwise(F.date_format("publication_date", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    subject = F.struct("name", "place_of_birth", "aliases")
    item = F.struct(
        "uid", "title", "description",
        F.when(F.pmod(key, F.lit(7)) != 0, F.array(subject)).alias("subjects"),
        spelled.alias("publication"),
        F.date_format("modified_date", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
        "reward_text", "images",
    )
    return n.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))


def _flat_columns(flat):
    return flat.select(
        "uid", "title", "description", "name", "place_of_birth", "publication_date", "modified_date",
        "reward_text", "case_age_days",
        F.size("subjects").alias("n_subjects"), F.size("images").alias("n_images"), F.size("aliases").alias("n_aliases"),
    )


@query
def notice_payloads(spark, sf):
    """Pages landed as a text column -> flat notices."""
    items = src_notices.parse_notice_pages(_payloads(spark, sf))
    return _flat_columns(src_notices.flatten_notices(items, R.INGESTED))


@query
def notice_page_files(spark, sf):
    """Pages landed as JSON-lines files -> flat notices."""
    path = f"{shared_folder(spark)}/pages"
    _payloads(spark, sf).write.text(path)
    items = src_notices.read_notice_pages(spark, path, one_page_per_file=False)
    return _flat_columns(src_notices.flatten_notices(items, R.INGESTED))


@query
def notice_pages_of_customers(spark, sf):
    """A page per customer with an item per order, none for many, and every field of items and subjects filled."""
    o, c = R.table(spark, sf, "orders"), R.table(spark, sf, "customer")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = lambda prefix, column="o_orderkey": F.concat(F.lit(prefix), F.col(column).cast("string"))
    subject = F.struct(
        text("name ", "o_custkey").alias("name"), F.lit("Male").alias("sex"), text("race ", "o_orderstatus").alias("race"),
        text("nation ", "o_orderstatus").alias("nationality"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("date_of_birth"),
        text("place ", "o_custkey").alias("place_of_birth"), F.lit("brown").alias("hair"), F.lit("blue").alias("eyes"),
        F.lit("60").alias("height_min"), F.lit("70").alias("height_max"), text("", "o_totalprice").alias("weight"),
        F.array(text("alias "), text("also ")).alias("aliases"),
    )
    item = F.struct(
        text("u").alias("uid"), F.col("o_orderpriority").alias("title"), text("about ").alias("description"),
        F.array(subject, subject).alias("subjects"), day.alias("publication"), day.alias("modified"), text("http://x/").alias("url"),
        text("armed ").alias("warning_message"), text("reward ").alias("reward_text"), text("caution ").alias("caution"),
        text("details ").alias("details"), F.array(text("i")).alias("images"), F.array(text("f"), text("g")).alias("files"),
    )
    per = o.select(F.col("o_custkey").alias("c_custkey"), item.alias("item")).groupBy("c_custkey").agg(F.collect_list("item").alias("items"))
    pages = c.select("c_custkey").join(per, "c_custkey", "left").select(
        F.to_json(F.struct(F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"))).alias("payload"))
    flat = src_notices.flatten_notices(src_notices.parse_notice_pages(pages), R.INGESTED)
    lists = [f.name for f in flat.schema if isinstance(f.dataType, T.ArrayType) and f.name != "subjects"]
    kept = [f.name for f in flat.schema if not isinstance(f.dataType, T.ArrayType)]
    return flat.select(*kept, F.size("subjects").alias("n_subjects"), *[F.array_join(n, "|").alias(n) for n in lists])


@query
def baseline_all_years(spark, sf):
    """Baseline pages in one folder per year, all of them read back."""
    path = f"{shared_folder(spark)}/baseline"
    record = F.struct("state", "offense_type", "count", "rate_per_100k")
    R.baseline(spark, sf).select("year", F.array(record).alias("data")).write.partitionBy("year").json(path)
    return src_baseline.read_baseline(spark, path, one_page_per_file=False)


@query
def baseline_families(spark, sf):
    """Baseline records with their offense family."""
    return R.baseline(spark, sf)


@query
def baseline_year_folders(spark, sf):
    """Baseline pages in one folder per year; a year list reads only its folders."""
    path = f"{shared_folder(spark)}/baseline"
    records = R.baseline(spark, sf)
    record = F.struct("state", "offense_type", "count", "rate_per_100k")
    records.select("year", F.array(record).alias("data")).write.partitionBy("year").json(path)
    return src_baseline.read_baseline(spark, path, years=[1997, 1998, 1999], one_page_per_file=False)


@query
def csv_round_trip(spark, sf):
    """Engineered notices exported to CSV and read back with their types."""
    path = f"{shared_folder(spark)}/features_csv"
    files.write_csv(R.features(spark, sf).select(*files.FEATURE_CSV.names), path)
    back = files.read_feature_csv(spark, path)
    return back.select(
        "uid", "title", "publication_date", "case_age_days", "birth_state", "severity_flag", "has_reward",
        "has_images", F.size("images").alias("n_images"), "reward_text",
    )


@query
def json_results(spark, sf):
    """A result table written as JSON and read back."""
    folder = shared_folder(spark)
    files.write_json({"weapons": wpn.weapon_distribution(R.features(spark, sf))}, folder)
    return spark.read.schema("weapon_category string, n long, percentage double").json(f"{folder}/weapons")


@query
def stored_notices(spark, sf):
    """Notices saved to the stored table, loaded with an equality and a list filter."""
    store = TableStore(spark, shared_folder(spark))
    store.create_tables()
    store.save_wanted(R.features(spark, sf))
    store.save_wanted(R.features(spark, sf), known="skip")
    return store.load_wanted({"crime_family": "Violent", "publication_year": [1996, 1999]}).select(
        "uid", "title", "birth_state", "birth_region", "crime_family", "publication_year", "publication_quarter",
        "case_age_category", "case_age_days", "has_reward", "has_images",
    )


@query
def stored_baseline(spark, sf):
    store = TableStore(spark, shared_folder(spark))
    store.create_tables()
    store.save_baseline(R.baseline(spark, sf))
    return store.load_baseline({"state": "R", "crime_family": ["cyber_crime", "other"]}).select(
        "year", "state", "offense_type", "crime_family", "count", "rate_per_100k"
    )


@query
def analysis_history(spark, sf):
    """Test results appended to the history table, newest first."""
    store = TableStore(spark, shared_folder(spark))
    store.create_tables()
    nations = rep.chi_square(_nations(spark, sf)).withColumns({
        "interpretation": F.lit("nations"), "sample_size": F.col("units_tested"), "confidence_level": F.lit(K.CONFIDENCE),
    })
    anova = per.anova(R.features(spark, sf)).withColumn("interpretation", F.col("status"))
    few = per.anova(R.features(spark, sf).where("crime_family = 'Violent'")).withColumn("interpretation", F.col("status"))
    store.save_results(res.stored_results(res.result_table(nations, untested=True), ANALYSED))
    store.save_results(res.stored_results(res.result_table(persistence=anova, untested=True), datetime(2001, 8, 4)))
    store.save_results(res.stored_results(res.result_table(persistence=few, untested=True), datetime(2001, 8, 2)))
    history = store.analysis_history()
    ids = history.agg(F.count_distinct("id")).scalar()
    return history.select(
        "analysis_type", "analysis_date", "confidence_level", "test_statistic", "p_value", "significant_bias",
        "interpretation", "sample_size", F.get_json_object("metadata", "$.status").alias("status"), ids.alias("ids"),
    )


@query
def combined_sources(spark, sf):
    """Customers and suppliers under common names, a column one of them lacks being null."""
    sources = {"customer": R.table(spark, sf, "customer"), "supplier": R.table(spark, sf, "supplier")}
    return src_baseline.combine_sources(sources, {
        "customer": {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "segment": "c_mktsegment"},
        "supplier": {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"},
    })


# --- features ---------------------------------------------------------------

@query
def birth_places(spark, sf):
    """State, population and region from the place text."""
    return feat.add_geography(R.notices(spark, sf)).select("uid", "birth_state", "birth_state_population", "birth_region")


@query
def state_codes_in_urls(spark, sf):
    """First state code in each page address."""
    pages = R.table(spark, sf, "pages").withColumn("u", F.upper("url"))
    return pages.select("page_id", first_code("u", K.STATE_CODES, K.UNKNOWN_STATE).alias("state"))


@query
def state_codes_in_part_names(spark, sf):
    part = R.table(spark, sf, "part").withColumn("u", F.upper("p_name"))
    return part.select("p_partkey", first_code("u", K.STATE_CODES, K.UNKNOWN_STATE).alias("state"))


@query
def publication_calendar(spark, sf):
    return feat.add_calendar(R.notices(spark, sf)).select(
        "uid", "publication_year", "publication_quarter", "publication_month", "case_age_months", "case_age_years",
        "case_age_category",
    )


@query
def notice_text_rules(spark, sf):
    """Family, weapon, severity and the searched text of every notice."""
    return feat.add_text_rules(R.notices(spark, sf)).select(
        "uid", "weapon_raw", "crime_family", "weapon_category", "severity_flag", "public_notice_flag"
    )


@query
def document_text_rules(spark, sf):
    """The same rules over whole documents."""
    d = R.table(spark, sf, "documents")
    return feat.add_text_rules(d, "source", "text").select(
        "doc_id", "crime_family", "weapon_category", "severity_flag", F.length("weapon_raw").alias("n_searched")
    )


@query
def document_topics(spark, sf):
    """Another taxonomy over whole documents, with a flag for one list of phrases."""
    d = R.table(spark, sf, "documents").withColumn("t", F.lower("text"))
    return d.select(
        "doc_id", classify(F.col("t"), TOPICS, "plain").alias("topic"),
        contains_any(F.col("t"), ["license", "the"]).alias("flag"),
    )


@query
def page_topics(spark, sf):
    """Topics of whole raw pages per topic."""
    p = R.table(spark, sf, "pages").withColumn("t", F.lower("html"))
    topic = classify(F.col("t"), [("cookies", ["cookie"]), ("links", ["<a href", "<a "])], "none")
    return cnt.label_counts(p.select(topic.alias("topic")), "topic")


@query
def notice_activity(spark, sf):
    return feat.add_activity(R.notices(spark, sf)).select(
        "uid", "days_since_modified", "recently_updated", "has_reward", "has_images"
    )


@query
def event_age(spark, sf):
    """24-hour spans from each event to a fixed instant, negative after it."""
    at = F.lit(datetime(2024, 1, 15, 12, 30))
    return R.table(spark, sf, "events").select("event_id", floor_days(at, F.col("ts")).alias("days"))


@query
def engineered_notices(spark, sf):
    """All derived columns with the yearly baseline joined."""
    e = feat.engineer_features(R.notices(spark, sf), R.baseline(spark, sf))
    return e.select(
        "uid", "birth_state", "birth_region", "publication_year", "case_age_category", "crime_family",
        "weapon_category", "severity_flag", "recently_updated", "has_reward", "has_images",
        "year", "count", "rate_per_100k",
    )


@query
def baseline_without_crosswalk(spark, sf):
    """The two vocabularies as they are: nothing matches, every baseline column stays null."""
    e = joins.join_baseline(R.features(spark, sf), R.baseline(spark, sf), crosswalk=None)
    return e.groupBy("crime_family").agg(F.count(F.lit(1)).alias("n"), F.count("count").alias("matched"))


@query
def known_places(spark, sf):
    """Rows kept by the unknown-state filter; null states stay."""
    return feat.known_places(R.features(spark, sf)).groupBy("birth_state").agg(F.count(F.lit(1)).alias("n"))


@query
def selected_years(spark, sf):
    return cnt.label_counts(feat.select_years(R.features(spark, sf), [1996, 1998]), "crime_family")


@query
def available_years(spark, sf):
    return feat.available_years(R.features(spark, sf))


@query
def sample_gate(spark, sf):
    return feat.sample_gate(R.features(spark, sf))


# --- counts and shares -----------------------------------------------------

@query
def family_counts(spark, sf):
    return cnt.ranked(cnt.label_counts(R.features(spark, sf), "crime_family"), "crime_family")


@query
def family_proportions(spark, sf):
    return cnt.distribution(R.features(spark, sf), "crime_family")


@query
def state_proportions(spark, sf):
    """Share of all rows, those without a state included in the base."""
    return cnt.distribution(R.features(spark, sf), "birth_state")


@query
def state_proportions_known(spark, sf):
    return cnt.distribution(R.features(spark, sf), "birth_state", over="known")


@query
def yearly_baseline(spark, sf):
    return joins.yearly_baseline(R.baseline(spark, sf))


@query
def baseline_distribution(spark, sf):
    return cat.baseline_distribution(R.baseline(spark, sf))


@query
def case_cube(spark, sf):
    return cnt.case_cube(R.features(spark, sf))


@query
def year_by_family(spark, sf):
    return datasets.temporal_series(R.features(spark, sf))


@query
def year_by_family_from_cube(spark, sf):
    """The same out of the cube: roll-ups of one count equal direct counts."""
    return datasets.temporal_series(cnt.case_cube(R.features(spark, sf)), weight="n")


@query
def year_by_weapon(spark, sf):
    return cnt.yearly_shares(R.features(spark, sf), "weapon_category")


@query
def region_by_family(spark, sf):
    return datasets.region_by_family(R.features(spark, sf))


@query
def nation_by_priority(spark, sf):
    """Sparse two-way shares of orders: nation against priority, no grid."""
    o, c = R.table(spark, sf, "orders"), R.table(spark, sf, "customer")
    both = o.join(c, o["o_custkey"] == c["c_custkey"])
    return cnt.within(cnt.cells(both, "c_nationkey", "o_orderpriority"), "c_nationkey")


@query
def year_by_customer(spark, sf):
    """Shares of customers within a year: a table of many labels, sparse."""
    o = R.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return cnt.two_way(o, "year", "o_custkey", normalize="row")


@query
def distinct_labels(spark, sf):
    return cnt.distinct_labels(R.features(spark, sf), ["crime_family", "birth_state", "weapon_category"])


@query
def distinct_customers(spark, sf):
    """Distinct counts on high-cardinality keys."""
    return cnt.distinct_labels(R.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@query
def overview(spark, sf):
    return cnt.overview(R.features(spark, sf))


@query
def yearly_counts(spark, sf):
    return cnt.row_counts(R.features(spark, sf), "publication_year")


@query
def concentration(spark, sf):
    return cnt.concentration(R.features(spark, sf), since=2000)


@query
def severity_metrics(spark, sf):
    return cnt.severity_metrics(R.features(spark, sf))


@query
def severity_metrics_all_rows(spark, sf):
    return cnt.severity_metrics(R.features(spark, sf), serious_only=False)


@query
def weapon_completeness(spark, sf):
    return cnt.weapon_completeness(feat.serious_only(R.features(spark, sf)))


@query
def first_and_last_year(spark, sf):
    f = R.features(spark, sf)
    return cnt.first_and_last(cnt.cells(f, "publication_year", "crime_family"), "crime_family", "publication_year")


@query
def example_notices(spark, sf):
    """The sample rows of the check report: first three by uid, description cut to 60 characters."""
    return cnt.example_rows(feat.serious_only(R.features(spark, sf)).select(
        "uid", F.coalesce("title", F.lit("")).alias("title"), F.col("weapon_raw").alias("description")))


# --- tests -----------------------------------------------------------------

@query
def geographic_representation(spark, sf):
    return rep.representation(R.features(spark, sf))


@query
def geographic_summary(spark, sf):
    return rep.analyze_geography(R.features(spark, sf))["summary"]


@query
def geographic_test(spark, sf):
    return rep.analyze_geography(R.features(spark, sf))["test"]


@query
def category_comparison(spark, sf):
    return cat.analyze_categories(R.features(spark, sf), R.baseline(spark, sf))["category_comparison"]


@query
def category_test(spark, sf):
    return cat.analyze_categories(R.features(spark, sf), R.baseline(spark, sf))["test"]


@query
def segment_test(spark, sf):
    """Orders per market segment against customers per segment."""
    o, c = R.table(spark, sf, "orders"), R.table(spark, sf, "customer")
    orders = cnt.distribution(o.join(c, o["o_custkey"] == c["c_custkey"]), "c_mktsegment")
    return cat.category_test(orders, cnt.distribution(c, "c_mktsegment"), "c_mktsegment")


@query
def family_trends(spark, sf):
    return trd.trend(R.features(spark, sf))


@query
def priority_trends(spark, sf):
    """Monthly order counts per priority."""
    o = R.table(spark, sf, "orders").withColumn(
        "month", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    return trd.trend(o, "o_orderpriority", "month")


@query
def customer_trends(spark, sf):
    """Yearly orders of every customer, years without an order counting 0: sparse cells, no grid."""
    o = R.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return trd.trend(o, "o_custkey", "year")


@query
def strong_trends(spark, sf):
    return trd.strong_trends(trd.trend(R.features(spark, sf)), 0.5)


@query
def significant_trend_count(spark, sf):
    o = R.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return trd.significant_trend_count(trd.trend(o, "o_custkey", "year"))


@query
def case_persistence(spark, sf):
    return per.persistence(R.features(spark, sf))


@query
def case_persistence_test(spark, sf):
    return per.analyze_persistence(R.features(spark, sf))["test"]


def _delays(spark, sf):
    li, o, p = (R.table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    days = floor_days(F.col("l_shipdate"), F.col("o_orderdate"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(
        "p_type", days.alias("delay_days"), "l_extendedprice"
    )


@query
def delay_by_part_type(spark, sf):
    """Days from order to shipment (also negative) per part type."""
    return per.persistence(_delays(spark, sf), "p_type", "delay_days", whole_days=True)


@query
def delay_anova(spark, sf):
    return per.anova(_delays(spark, sf), "p_type", "delay_days")


@query
def price_quantiles(spark, sf):
    """Exact quartiles of a continuous value per return flag, through buckets."""
    return per.box_stats(R.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", whole_days=False)


@query
def event_value_statistics(spark, sf):
    return per.persistence(R.table(spark, sf, "events"), "event_type", "value", whole_days=False)


@query
def weapon_totals(spark, sf):
    return wpn.weapon_totals(R.features(spark, sf))


@query
def weapon_extremes(spark, sf):
    f = feat.serious_only(R.features(spark, sf))
    return cnt.extremes(cnt.label_counts(f, "weapon_category"), "weapon_category")


@query
def weapon_quality(spark, sf):
    return wpn.weapon_quality(feat.serious_only(R.features(spark, sf)))


@query
def weapon_quality_raw(spark, sf):
    """The same score where the weapon text is optional: rows both unknown and missing count twice."""
    f = R.features(spark, sf).withColumn("weapon_raw", F.col("reward_text"))
    return wpn.weapon_quality(f)


@query
def weapon_comparison(spark, sf):
    return wpn.compare_subset(R.features(spark, sf))


@query
def event_type_comparison(spark, sf):
    """Event types among high values against all events, over the types present."""
    e = R.table(spark, sf, "events").withColumn("high", F.col("value") > 50)
    return wpn.compare_subset(e, "event_type", "high", domain=None, points=0.5)


@query
def toxic_label_comparison(spark, sf):
    """Sources of toxic documents against all labelled documents."""
    d, l = R.table(spark, sf, "documents").select("doc_id", "source", "lang"), R.table(spark, sf, "labels")
    both = d.join(l, "doc_id").withColumn("flag", F.col("toxic") == 1)
    return wpn.compare_subset(both, "lang", "flag", domain=None)


@query
def unknown_weapon_trend(spark, sf):
    return wpn.unknown_trend(feat.serious_only(R.features(spark, sf)))


@query
def unknown_weapon_direction(spark, sf):
    return wpn.unknown_direction(wpn.unknown_trend(feat.serious_only(R.features(spark, sf))))


@query
def years_analyzed(spark, sf):
    return wpn.periods_analyzed(feat.serious_only(R.features(spark, sf)))


@query
def regions_analyzed(spark, sf):
    return wpn.periods_analyzed(feat.serious_only(R.features(spark, sf)), "birth_region")


@query
def weapon_summary(spark, sf):
    return wpn.analyze_weapons(R.features(spark, sf))["summary"]


def _audit(spark, sf):
    return audit.run_audit(R.notices(spark, sf), R.baseline(spark, sf), shared_folder(spark))


@query
def audit_results(spark, sf):
    """The whole audit on stored features and counts: its result table."""
    return report.test_lines(_audit(spark, sf)["report.results"])


@query
def audit_results_of_batches(spark, sf):
    """Notices in three batches, each counted for itself: the result table of the merged states."""
    log = audit.AuditLog(spark, shared_folder(spark))
    notices = R.notices(spark, sf)
    of = F.pmod(F.xxhash64("uid"), F.lit(3))
    for i in range(3):
        log.add(f"batch {i}", notices.where(of == i))
    return report.test_lines(log.tables(R.baseline(spark, sf))["report.results"])


@query
def audit_findings(spark, sf):
    return _audit(spark, sf)["report.findings"]


@query
def audit_badges(spark, sf):
    return _audit(spark, sf)["report.badges"]


@query
def audit_weapon_summary(spark, sf):
    return _audit(spark, sf)["weapons.summary"]


@query
def report_summary(spark, sf):
    return report.dataset_summary(cnt.overview(R.features(spark, sf)))


@query
def report_trending(spark, sf):
    """Customers whose yearly orders move significantly, as printed."""
    o = R.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    t = trd.trend(o, "o_custkey", "year").withColumnRenamed("o_custkey", "crime_family")
    return report.trending_categories(t)


@query
def report_weapon_lines(spark, sf):
    return report.weapon_lines(wpn.weapon_distribution(feat.serious_only(R.features(spark, sf))))


# --- chart data sets -------------------------------------------------------

@query
def charts_from_one_pass(spark, sf):
    """Year, region and family tables with their totals, all from one aggregate, as long rows."""
    t = datasets.chart_tables(R.features(spark, sf))
    null = F.lit(None).cast("double")

    def long(name, a, b, value=None):
        key = [F.lit(None).cast("string") if c is None else F.col(c).cast("string") for c in (a, b)]
        return t[name].select(F.lit(name).alias("chart"), key[0].alias("a"), key[1].alias("b"), "n", (null if value is None else F.round(value, 6) + 0.0).alias("value"))

    return reduce(DataFrame.unionByName, [
        long("temporal_series", "publication_year", "crime_family"),
        long("region_by_family", "birth_region", "crime_family", "share"),
        long("weapon_yearly", "publication_year", "weapon_category", "percentage"),
        long("weapon_by_region", "birth_region", "weapon_category", "percentage"),
        long("category_distribution", "crime_family", None, "proportion"),
        long("weapon_distribution", "weapon_category", None, "percentage"),
        long("years", "publication_year", None), long("regions", "birth_region", None),
        long("families", "crime_family", None), long("total", None, None),
    ])


@query
def chart_summary_persistence_by_appearance(spark, sf):
    """The summary box plot of the first five families in the order in which they appear."""
    return datasets.summary_persistence(R.features(spark, sf, position=True), order="appearance")


@query
def customers_by_appearance(spark, sf):
    """The first ten customers in the order of the orders file, with their orders."""
    counted = cnt.appearance_counts(files.with_row_position(R.table(spark, sf, "orders")), "o_custkey")
    return cnt.ranked(counted, "o_custkey", 10, "appearance").select("o_custkey", "n")


@query
def customers_from_sketches(spark, sf):
    """Distinct customers and orders of a year, estimated from a cube of sketches, within their stated error of the exact counts."""
    o = R.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    cube = cnt.sketched_counts(o, ["year", "o_orderstatus", "o_orderpriority"], ["o_custkey", "o_orderkey"])
    told = cnt.distinct_estimates(cube, ["year"], ["o_custkey", "o_orderkey"])
    exact = o.groupBy(F.col("year").alias("_year")).agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"))

    def near(estimate, n):
        return F.abs(F.col(estimate) - F.col(n)) <= F.col("distinct_error") * F.col(n)

    joined = told.join(exact, F.col("year").eqNullSafe(F.col("_year")))  # orders without a date are a year of their own
    return joined.select("year", "n", "customers", near("o_custkey", "customers").alias("customers_near"), near("o_orderkey", "orders").alias("orders_near"))


@query
def chart_categories(spark, sf):
    return datasets.category_distribution(R.features(spark, sf))


@query
def chart_states(spark, sf):
    return datasets.geographic_distribution(R.features(spark, sf))


@query
def chart_top_states(spark, sf):
    return datasets.top_states_with_share(R.features(spark, sf))


@query
def chart_scatter(spark, sf):
    return rep.scatter(rep.representation(R.features(spark, sf)))


@query
def chart_category_proportions(spark, sf):
    a = cat.analyze_categories(R.features(spark, sf), R.baseline(spark, sf))
    return datasets.category_proportions(a["wanted_distribution"], a["baseline_distribution"])


@query
def chart_persistence_box(spark, sf):
    return datasets.persistence_box(R.features(spark, sf))


@query
def chart_representation_ratios(spark, sf):
    return datasets.representation_ratios(rep.representation(R.features(spark, sf)))


@query
def chart_summary_persistence(spark, sf):
    f = R.features(spark, sf)
    return datasets.summary_dashboard(f, cnt.case_cube(f))["persistence"]


@query
def chart_summary_categories(spark, sf):
    f = R.features(spark, sf)
    return datasets.summary_dashboard(f, cnt.case_cube(f))["categories"]


@query
def chart_summary_years(spark, sf):
    f = R.features(spark, sf)
    return datasets.summary_dashboard(f, cnt.case_cube(f))["years"]


@query
def chart_summary_states(spark, sf):
    f = R.features(spark, sf)
    return datasets.summary_dashboard(f, cnt.case_cube(f))["states"]


@query
def p_values_of_nations(spark, sf):
    """Small p-values as logarithms: orders of each nation over the priorities, the statistic raised nation by nation."""
    o, c = R.table(spark, sf, "orders"), R.table(spark, sf, "customer")
    counted = cnt.cells(o.join(c, o["o_custkey"] == c["c_custkey"]), "c_nationkey", "o_orderpriority")
    even = F.sum("n") / F.count(F.lit(1))
    each = counted.groupBy(F.col("c_nationkey").alias("nation")).agg(
        ((F.sum(F.col("n") * F.col("n")) / even - F.sum("n")) * (1 + F.col("c_nationkey"))).alias("statistic"),
        (F.count(F.lit(1)) - 1).alias("df"),
    )
    return each.select("nation", "statistic", F.log10(special.chi2_p_value("statistic", "df")).alias("log10_p"))


@query
def chart_weapons(spark, sf):
    return datasets.weapon_distribution(R.features(spark, sf))


@query
def chart_weapons_all(spark, sf):
    return datasets.weapon_distribution(R.features(spark, sf), serious=False)


@query
def chart_weapon_comparison(spark, sf):
    return wpn.weapon_comparison_chart(R.features(spark, sf))


@query
def chart_weapons_by_year(spark, sf):
    return datasets.weapon_yearly(R.features(spark, sf))


@query
def chart_unknown_by_year(spark, sf):
    return datasets.unknown_weapons_by_year(R.features(spark, sf))


@query
def chart_weapons_by_region(spark, sf):
    return datasets.weapon_by_region(R.features(spark, sf))


@query
def chart_geographic_table(spark, sf):
    return datasets.geographic_table(rep.representation(R.features(spark, sf)))


# --- quality ---------------------------------------------------------------

def _repeated(spark, sf):
    """Every fourth notice twice, the copy changed a day later; every ninth without a uid."""
    n = R.notices(spark, sf).drop("aliases")
    key = F.expr("cast(substring(uid, 2) as bigint)")
    copies = n.where(F.pmod(key, F.lit(4)) == 0).withColumn(
        "modified_date", F.col("modified_date") + F.expr("interval 1 day"))
    return n.unionByName(copies).withColumn("uid", F.when(F.pmod(key, F.lit(9)) != 0, F.col("uid")))


@query
def validation(spark, sf):
    return qual.validate(_repeated(spark, sf), minimum=("case_age_days", 10))


@query
def validation_text_dates(spark, sf):
    """Rules over text: dates in several spellings, numbers written out, some of both unreadable."""
    o = R.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    date = F.col("o_orderdate").cast("timestamp")
    spelled = (
        F.when(key % 50 == 0, F.lit("no date")).when(key % 50 == 1, F.date_format(date, "MM/dd/yyyy"))
        .when(key % 50 == 2, F.date_format(date, "MMMM d, yyyy")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    )
    rows = o.select(
        key.cast("string").alias("uid"), spelled.alias("publication_date"), F.col("o_custkey").alias("customer"),
        F.when(key % 7 == 0, F.lit("many")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    return qual.validate(
        rows, required=("uid", "comment"), unique="customer", minimum=("price", 1000),
        types={"publication_date": "date", "price": "whole", "priority": "text", "customer": "text"},
    )


@query
def repeated_keys(spark, sf):
    return qual.duplicated_keys(_repeated(spark, sf))


@query
def latest_notices(spark, sf):
    return qual.newest_rows(_repeated(spark, sf)).select("uid", "title", "modified_date", "case_age_days")


@query
def distinct_documents(spark, sf):
    """Exact copies of whole documents removed."""
    d = R.table(spark, sf, "documents").select("text", "lang")
    return qual.distinct_rows(d).select("lang", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@query
def document_quality(spark, sf):
    return qual.quality_metrics(R.table(spark, sf, "documents").select("text", "lang"))


@query
def notice_completeness(spark, sf):
    return qual.column_completeness(R.notices(spark, sf))


@query
def standardized_documents(spark, sf):
    d = qual.standardize_text(R.table(spark, sf, "documents"), ["text"])
    return d.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


@query
def standardized_states(spark, sf):
    p = R.table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("state"))
    return qual.standardize_states(p)


@query
def anonymized_notices(spark, sf):
    a = qual.anonymize(R.raw_notices(spark, sf))
    return a.select("uid", "name", F.get("aliases", F.lit(0)).alias("alias"))


@query
def retained_notices(spark, sf):
    return qual.retained(R.notices(spark, sf), R.INGESTED).select("uid", "case_age_days")
