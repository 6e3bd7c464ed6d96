"""Queries over the test tables, one or more for each group of operators, with their SQL in cleanloom.plans.oracle.

The tables are clean, so dirty values are made from keys, the same way here and in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from .. import vocabulary as V
from ..functions import dates, numeric
from ..functions import text as T
from ..operators import audit, detect, fuzzy, impute, outliers, profile, rows, schema
from ..sources import writers
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Values that stand in dirty tables, taken in turn by a key.
DEVICES = ("Wireless Mouse", "wireless mouse ", "Wireles Mouse", "Wireless Mouse", "Keyboard", "Keybord", "Keyboard", "Wireless Mouse", "Lamp")
PHONES = ("+201012345678", "01012345678", "00201112345678", "٠١٠١٢٣٤٥٦٧٨", "966512345678", "0512345678", "512345678", "11234567890", "+1 (415) 555-2671", "12345", "n/a", "+971501234567")
NUMBERS = ("1,234.56", "$250.50", "1500 ج.م", "3000 EGP", "(42)", "(-7.5)", "12%", "1.5K", "2M", "٣٤٥", "abc", "", "  88  ", "1 000 000", "-5", "3.", "12 kg")
DATES = ("2024-02-03", "15/03/2020", "3.4.2021", "2024-01-15 14:30:00", "January 5, 2023", "7 Feb 2022", "45292", "2026-02-30", "N/A", "", "12 مارس 2024", "1/2/99", "2050-01-01", "1850-05-05", "20 6 2019")
DATE_CELLS = ("delivered on 2024-09-22", "N/A", "01/01/224", "15-03-124", "2024-08-25", "2024-01-15 14:30:00", "sent 27/7/2024 late", "soon")
NAMES = ("أحمد علي", "احمد على", "مُحَمَّد", "فاطمـــة", "John Smith", "  john   smith ", "JOHN@SMITH", "Sara سارة", "٣ أولاد", "N/A", "unknown", "--", "", "o'neil new-york", "هبَة")
MISSING = ("unknown", " N/A ", "ok", "-", "none!", "value", "غير محدد", "", "NaN", "***missing***", "nil", "data")


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(key: str, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities are missing for some parts altogether and for some orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({"l_quantity": F.when((F.col("l_partkey") % 7 == 0) | (F.col("l_orderkey") % 11 == 0), None).otherwise(F.col("l_quantity")), "grade": F.nullif("l_returnflag", F.lit("N"))})


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gone = lambda c, n, k: F.when(F.col("o_orderkey") % n == k, None).otherwise(F.col(c)).alias(c)
    return o.select("o_orderkey", "o_custkey", gone("o_orderstatus", 9, 4), gone("o_orderpriority", 5, 2), gone("o_totalprice", 13, 1), "o_orderdate")


def _money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,4)")).cast("double")


# Functions of text.


@query
def text_missing(spark, sf_dir):
    v = picked("c_custkey", MISSING)
    c = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    return c.select("c_custkey", T.is_missing(F.col("v")).alias("app"), T.is_missing(F.col("v"), V.IMPUTATION_MISSING).alias("imputer"), T.is_placeholder(F.col("v")).alias("placeholder"), T.blank_to_null(F.col("v")).alias("kept"), T.tokens_to_null(F.col("v")).alias("reader"))


@query
def text_arabic(spark, sf_dir):
    v = picked("c_custkey", NAMES)
    return table(spark, sf_dir, "customer").select("c_custkey", T.western_digits(v).alias("digits"), T.arabic(v).alias("arabic"), T.arabic_plain(v).alias("plain"), T.arabic_sanitised(v).alias("sanitised"), T.arabic_for_matching(v).alias("matching"), T.language(v).alias("language"))


@query
def text_english(spark, sf_dir):
    v = F.concat(F.lit(" ("), "p_name", F.lit(", "), "p_type", F.lit(")!  "), "p_brand", F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip(v).alias("stripped"), T.english(v).alias("english"), T.english_sanitised(v).alias("sanitised"), T.for_matching(v).alias("matching"), F.array_join(T.keywords(v), "|").alias("keywords"))


@query
def text_contractions(spark, sf_dir):
    v = F.concat(picked("p_partkey", ("Can't stop", "we won't go", "it isn't", "they're here", "she's in", "I'd say", "you'll see", "we've been", "I'm off", "w/ milk", "plain")), F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.expand_contractions(v).alias("expanded"))


@query
def text_normalised(spark, sf_dir):
    v = picked("c_custkey", NAMES)
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalised(v).alias("normalised"), T.imputation_text(v).alias("imputer"), T.charset_normalised(v).alias("charset"), T.clean_value(v).alias("value"))


@query
def text_documents_words(spark, sf_dir):
    """Whole documents in the imputers' form: words left, distinct keywords, language of letters."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.english_sanitised(F.col("text")).alias("t"), F.size(T.keywords(F.col("text"))).alias("keywords"), T.language(F.col("text")).alias("script"))
    return d.select("doc_id", F.size(F.split("t", " ")).cast("long").alias("words"), F.col("keywords").cast("long").alias("keywords"), "script")


@query
def text_unicode_forms(spark, sf_dir):
    v = picked("c_custkey", ("ﬁne", "Ａ１", "café", "naïve №5", "سؤال", "فاطمـــة", "plain"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.nfkc(v).alias("nfkc"), T.ascii_fold(v).alias("folded"), T.clean_text(v).alias("cleaned"), T.person_name(v).alias("person"), T.python_title(v).alias("title"))


# Numbers, phones, dates.


@query
def numeric_mixed(spark, sf_dir):
    v = picked("c_custkey", NUMBERS)
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.mixed_number(v).alias("number"), numeric.plain_double(v).alias("plain"), numeric.boolean_text(picked("c_custkey", ("Yes", "no", "TRUE", "0", "maybe", "نعم"))).alias("boolean"))


@query
def phone_standard(spark, sf_dir):
    v = picked("c_custkey", PHONES)
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.phone(v).alias("phone"), numeric.phone(v, compat=False).alias("repaired"))


@query
def date_parse(spark, sf_dir):
    v = picked("c_custkey", DATES)
    c = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return c.select("c_custkey", iso(dates.parse(F.col("v"))).alias("parsed"), iso(dates.within_bounds(F.col("v"), "2025-01-01")).alias("bounded"), dates.bound_failure(F.col("v"), "2025-01-01").alias("failure"), iso(dates.excel_serial(F.col("c_custkey").cast("string"))).alias("serial"))


@query
def date_cells(spark, sf_dir):
    """What becomes of cells, as an anomaly table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", DATE_CELLS).alias("when"))
    cleaned, anomalies = audit.clean_dates(c, ["when"], ["c_custkey"], 2025)
    return cleaned.join(anomalies.select("c_custkey", "action_taken"), "c_custkey", "left")


@query
def date_chronology(spark, sf_dir):
    """Ship dates before order dates."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = li.join(o, "l_orderkey")
    out, _ = audit.clean_dates(joined, [], ["l_orderkey"], 2025, ["o_orderdate", "l_shipdate"])
    return out.groupBy("is_chronology_invalid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("checksum"))


@query
def date_bounds_log(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", DATES).alias("when"))
    return audit.bounded_dates(c, ["when"], "2025-01-01")[1]


# Detection, profiles, quality.


@query
def detect_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(picked("c_custkey", NUMBERS).alias("amount_text"), picked("c_custkey", PHONES).alias("contact"), F.concat("c_name", F.lit("@example.com")).alias("mail"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("active"))
    cols = ["total", "filled", "distinct_values", "numbers", "booleans", "emails", "mean_length", "english"]
    return detect.evidence(c).select("column", *(F.round(x, 6).alias(x) if x not in ("total", "filled", "distinct_values") else F.col(x) for x in cols))


@query
def detect_types(spark, sf_dir):
    """Kinds of columns of a text table."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("shipped"), F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderpriority", F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("no").alias("flag"))
    return spark.createDataFrame([(k, v["type"], v["engine_type"], v["language"]) for k, v in detect.types(c).items()], "column string, type string, engine_type string, language string")


@query
def detect_roles(spark, sf_dir):
    r = detect.roles(dirty_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    return r.select("column", "role", "filled", F.round("distinct_ratio", 6).alias("distinct_ratio"), F.round("top_share", 6).alias("top_share"))


@query
def detect_grouping(spark, sf_dir):
    li = dirty_lineitem(spark, sf_dir)
    found = detect.grouping_scores(li, "l_extendedprice", ["l_quantity", "l_returnflag", "l_linenumber", "l_partkey"], 0.0)
    return found.select("group", F.round("score", 6).alias("score"))


@query
def detect_predictiveness(spark, sf_dir):
    return detect.predictiveness(dirty_orders(spark, sf_dir), "o_orderstatus", ["o_orderpriority", "o_custkey"]).select("feature", F.round("spread", 8).alias("spread"))


@query
def profile_numeric(spark, sf_dir):
    return profile.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query
def profile_missing(spark, sf_dir):
    return profile.missing(dirty_orders(spark, sf_dir))


@query
def profile_frequencies(spark, sf_dir):
    return profile.frequencies(dirty_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"], 3)


@query
def profile_dropping(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 20 == 0, F.lit("x")).alias("rare"), F.when(F.col("o_orderkey") % 100 == 0, "other").otherwise("same").alias("flat"))
    return profile.dropping(o).select("column", F.round("null_share", 6).alias("null_share"), F.round("top_share", 6).alias("top_share"), "high_missing", "low_variance", "recommend_drop")


@query
def profile_languages(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name", picked("c_custkey", NAMES).alias("full_name"))
    return profile.language_tally(c, ["c_name", "full_name"])


@query
def profile_whole(spark, sf_dir):
    p = profile.build(table(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    return p.select("column", "type", "total", "null_count", "unique", "mean", "median", "outliers", F.array_join(F.transform("top_values", lambda x: x["value"]), "|").alias("top"))


@query
def quality_score(spark, sf_dir):
    d = dirty_orders(spark, sf_dir).select(F.col("o_orderstatus"), "o_orderpriority", F.col("o_orderstatus").alias("copy"), F.col("o_custkey").cast("string").alias("as_text"))
    return profile.quality(d).select("score", *(F.round(c, 6).alias(c) for c in ("missing", "duplicates", "duplicate_columns", "numbers_as_text")))


# Columns and rows.


@query
def schema_duplicate_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("twin"), "o_custkey", "o_orderstatus", F.coalesce("o_orderstatus", F.lit("?")).alias("other"))
    return spark.createDataFrame([(c,) for c in schema.duplicate_columns(o)], "column string")


@query
def schema_types(spark, sf_dir):
    return schema.smallest_types(table(spark, sf_dir, "lineitem").drop("l_shipdate"))


@query
def schema_strict_numeric(spark, sf_dir):
    """Columns that may be cast are, others stay text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("total_price"), F.when(F.col("o_orderkey") == 5, "invalid").otherwise(F.col("o_custkey").cast("string")).alias("net_amount"))
    out = schema.strict_numeric(o)
    return out.select("o_orderkey", F.col("total_price").cast("decimal(12,2)").alias("total_price"), F.typeof("total_price").alias("kind"), "net_amount")


@query
def schema_standard_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("number"), picked("c_custkey", ("Yes", "no", "true", "0")).alias("flag"), picked("c_custkey", ("yes", "other")).alias("text"))
    return schema.standard_types(c)[0]


@query
def schema_typed_notes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("10", "20.5", "none yet", "1,000", "")).alias("amount"), picked("c_custkey", ("2024-02-03", "tomorrow", "2024-01-15 14:30:00")).alias("due"))
    out = schema.typed(c, ["amount"], ["due"])
    return out.select("c_custkey", "amount", F.date_format("due", "yyyy-MM-dd").alias("due"), "Notes")


@query
def schema_clean_numbers_log(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(picked("c_custkey", NUMBERS).alias("amount"))
    return schema.clean_numbers(c, ["amount"])[1]


@query
def rows_first_of_equal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return rows.drop_duplicates(o, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query
def rows_duplicate_documents(spark, sf_dir):
    return rows.duplicate_count(table(spark, sf_dir, "documents"), ["text"])


@query
def rows_metrics(spark, sf_dir):
    return rows.table_metrics(dirty_orders(spark, sf_dir))


@query
def rows_preview(spark, sf_dir):
    return rows.preview(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"], 100)


@query
def rows_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return rows.union_all([c, s]).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), _money("balance").alias("balance"))


@query
def rows_neighbour(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    return rows.neighbour(e, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query
def rows_carried(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
    return rows.carried(e, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


# Outliers and relations.


@query
def outlier_global(spark, sf_dir):
    return outliers.coordinates(table(spark, sf_dir, "events"), ["event_id"], ["value"])


@query
def outlier_flags(spark, sf_dir):
    f = outliers.flag(table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("square")), ["value", "square"], "beyond")
    return f.groupBy("beyond", F.col("beyondcells").alias("cells")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query
def outlier_grouped(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")
    f = outliers.flag_grouped(e, "value", ["event_type", "user_id"], flag_col="beyond")
    return f.groupBy("event_type", "beyond").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _related(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = F.when(F.col("l_orderkey") % 17 == 0, None).when(F.col("l_orderkey") % 23 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity") * F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), "l_tax", c.alias("c"))


@query
def relation_detect(spark, sf_dir):
    return outliers.products(_related(spark, sf_dir), ["a", "b", "l_tax", "c"]).select("a", "b", "c", "support", F.round("share", 6).alias("share"))


@query
def relation_repair(spark, sf_dir):
    out = outliers.repair_products(_related(spark, sf_dir), [("a", "b", "c")])
    return out.groupBy(F.col("c_calculation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("c", 4).cast("decimal(18,4)")).cast("double").alias("total"))


# Imputation.


@query
def impute_hier_median(spark, sf_dir):
    """Flagship: medians by part, by return flag, of the table, over line items with missing quantities."""
    out = impute.hierarchical_median(dirty_lineitem(spark, sf_dir), "l_quantity", "l_partkey", "grade", "status")
    return out.groupBy("l_returnflag", "status").agg(F.count(F.lit(1)).alias("n"), _money("l_quantity").alias("quantity"))


@query
def impute_fill(spark, sf_dir):
    out = impute.fill_missing(dirty_orders(spark, sf_dir), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    return out.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), _money("o_totalprice").alias("total"))


@query
def impute_grouped_median(spark, sf_dir):
    li = dirty_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity", "l_extendedprice")
    out = impute.grouped_median(li, ["l_quantity"], ["l_returnflag"], ["l_partkey", "l_returnflag"])
    return out.groupBy(F.col("l_quantity_imputation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"), _money("l_quantity").alias("quantity"))


@query
def impute_mode_context(spark, sf_dir):
    out = impute.categorical_by_context(dirty_orders(spark, sf_dir), ["o_orderpriority"], ["o_custkey", "o_orderstatus"])
    return out.select("o_orderkey", "o_orderpriority", F.col("o_orderpriority_imputation_status").alias("status"))


@query
def impute_waterfall(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type"), F.when((F.col("user_id") % 6 == 0) | (F.col("event_id") % 10 == 3), None).otherwise(F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"))
    out = impute.median_waterfall(e, "value", "user_id", "kind", ["ts", "event_id"], ["user_id"])
    return out.groupBy(F.col("value_imputation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"), _money("value").alias("total"))


@query
def impute_quantile_modes(spark, sf_dir):
    o = dirty_orders(spark, sf_dir)
    out = impute.mode_waterfall(o.withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(0.0))), "o_orderstatus", "o_custkey", "o_totalprice", ["o_orderkey"], ["o_orderpriority"])
    return out.select("o_orderkey", "o_orderstatus", F.col("o_orderstatus_imputation_status").alias("status"))


@query
def impute_by_features(spark, sf_dir):
    out = impute.text_by_features(dirty_orders(spark, sf_dir), "o_orderpriority", ["o_custkey", "o_orderstatus"], ["o_orderkey"], ["o_custkey"])
    return out.groupBy("o_orderpriority", F.col("o_orderpriority_prediction_type").alias("how")).agg(F.count(F.lit(1)).alias("n"))


@query
def impute_carried(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 == 0, F.lit("N/A")).otherwise(F.col("event_type")).alias("kind"))
    out = impute.cleaned_and_carried(e, ["value"], ["kind"], "user_id", "event_type", ["ts", "event_id"], ["user_id"])
    return out.groupBy(F.col("value_imputation_status").alias("value_status"), F.col("kind_imputation_status").alias("kind_status"), "kind").agg(F.count(F.lit(1)).alias("n"), _money("value").alias("total"))


@query
def impute_transactions(spark, sf_dir):
    li = dirty_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grade", "l_quantity")
    out = impute.by_transaction(li, "l_quantity", "l_partkey", "grade", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"])
    return out.groupBy(F.col("l_quantity_imputation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def impute_siblings(spark, sf_dir):
    o = dirty_orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit(" Cust. "), F.col("o_custkey").cast("string")).alias("customer"), "o_orderstatus", "o_orderpriority")
    out = impute.text_by_siblings(o, "o_orderpriority", ["customer", "o_orderstatus"])
    return out.select("o_orderkey", "o_orderpriority", F.col("o_orderpriority_predicted").alias("predicted"))


@query
def impute_from_descriptions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    colour = F.when(F.col("p_partkey") % 4 != 0, F.element_at(F.split("p_name", " "), 1))
    out = impute.text_by_siblings(p.select("p_partkey", "p_name", colour.alias("colour")), "colour", [], ["p_name"])
    return out.select("p_partkey", "colour", F.col("colour_predicted").alias("predicted"))


@query
def impute_summary(spark, sf_dir):
    out, told = pipelines.waterfall(dirty_orders(spark, sf_dir), ["o_totalprice"], ["o_orderstatus"], "o_custkey", "o_orderpriority", ["o_orderkey"], ["o_custkey"])
    return told


@query
def bins_quantile(spark, sf_dir):
    o = impute.quantile_bin(table(spark, sf_dir, "orders"), "o_totalprice", 5, "bin")
    o = impute.equal_width_bin(o, "o_totalprice", 4, "band")
    return o.groupBy("bin", "band").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query
def impute_number_bins(spark, sf_dir):
    o = dirty_orders(spark, sf_dir).withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(0.0)))
    out = impute.by_bins(o, "o_orderstatus", "o_custkey", "o_totalprice", ["o_orderpriority"], ["o_orderkey"], ["o_orderpriority"])
    return out.select("o_orderkey", "o_orderstatus", F.col("o_orderstatus_imputation_status").alias("status"))


@query
def impute_highlighted(spark, sf_dir):
    out = impute.categorical_by_context(dirty_orders(spark, sf_dir), ["o_orderpriority"], ["o_custkey"])
    return audit.highlighted(out, ["o_orderpriority_imputation_status"]).select("o_orderkey", F.array_join("_highlight", ",").alias("highlight"))


# Audit.


@query
def phone_log(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", (*PHONES, "")).alias("phone"))
    return pipelines.clean_phones(c, "phone")[1]


@query
def schema_empty_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("100", "N/A", "غير محدد", "", "500", "null", "NULL", "n/a", "غير متوفر")).alias("quantity"), picked("c_custkey", ("a", "", "N/A", "null")).alias("label"))
    return schema.standard_empty(c, ["quantity"])


@query
def rows_filter_outliers(spark, sf_dir):
    """Rows with a value beyond the quartiles, without a limit."""
    e = outliers.flag(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["value"], "beyond")
    return e.where("beyond").select("event_id", "user_id", "value")


@query
def cluster_phones(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(picked("c_custkey", ("+201012345678", "+201012345678", "+20101234567", "+966512345678", "none")).alias("phone"))
    return fuzzy.apply_mapping(c, fuzzy.phone_mapping(c, "phone", 95)).groupBy("phone").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_changes(spark, sf_dir):
    before = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = impute.sentinel_text(before, ["o_orderstatus", "o_orderpriority"])
    return rows.changed_cells(before, after, ["o_orderkey"])


@query
def audit_report(spark, sf_dir):
    before = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    trail = audit.AuditTrail(before)
    trail.changes(before, impute.sentinel_text(before, ["o_orderstatus"]), ["o_orderkey"], "status filled")
    trail.changes(before, impute.sentinel_text(before, ["o_orderpriority"]), ["o_orderkey"], "priority filled")
    return trail.summary()


@query
def audit_styles(spark, sf_dir):
    o = dirty_orders(spark, sf_dir)
    gone = audit.cell_kinds(o, ["o_orderkey"], ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]).withColumn("kind", F.lit("missing"))
    filled = o.where("o_orderpriority IS NULL AND o_custkey % 2 = 0").select("o_orderkey", F.lit("o_orderpriority").alias("column"), F.lit("imputed").alias("kind"))
    return audit.styles(gone.unionByName(filled), ["o_orderkey"])


@query
def audit_notes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("10", "ten", "")).alias("amount"), picked("c_custkey", ("2024-02-03", "later")).alias("due"))
    return audit.row_audit(c, {"amount": "numeric", "due": "date"}).select("c_custkey", "Notes")


@query
def audit_many_nulls(spark, sf_dir):
    return audit.many_nulls(dirty_orders(spark, sf_dir), 0.1).select("column", F.round("null_share", 6).alias("null_share"))


@query
def export_widths(spark, sf_dir):
    return writers.display_widths(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query
def export_text(spark, sf_dir):
    return writers.for_export(dirty_orders(spark, sf_dir).select(F.col("o_orderkey"), "o_orderstatus", "o_orderpriority", F.lit(1).alias("__hidden")))


@query
def export_json(spark, sf_dir):
    return writers.json_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


# Similar values.


def spelt_parts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    return p.select("p_partkey", F.when(k == 0, F.concat(F.lit(" "), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 50)))).when(k == 1, F.concat("p_type", F.lit("  "))).otherwise(F.col("p_type")).alias("kind"), F.concat(F.substring("p_brand", 7, 3), F.when(k == 3, F.lit("a")).otherwise(F.lit(""))).alias("code"))


@query
def cluster_norm_exact(spark, sf_dir):
    return fuzzy.exact_clusters(spelt_parts(spark, sf_dir), "kind", lambda c: F.lower(T.arabic_plain(c)))


@query
def cluster_levenshtein(spark, sf_dir):
    return fuzzy.short_pairs(spelt_parts(spark, sf_dir), "code").select("a", "b", F.col("distance").cast("int").alias("distance"))


@query
def cluster_semantic(spark, sf_dir):
    return fuzzy.harmonise(spelt_parts(spark, sf_dir), ["kind"])[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def cluster_token_set(spark, sf_dir):
    return fuzzy.token_set_harmonise(table(spark, sf_dir, "part"), ["p_name"], 90)[1]


@query
def cluster_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("Jon Smith", "John Smith", "john  smith", "Mary Jones", "Marry Jones")).alias("name"))
    return fuzzy.clean_names(c, ["name"])[0].groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def cluster_majority(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "furnitur").when(F.col("c_custkey") % 3 == 0, "machinery").otherwise("furniture").alias("segment"))
    return fuzzy.majority_words(c, ["segment"])[0].groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


# Pipelines.


@query
def pipeline_clean(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("customer_name"), picked("c_custkey", PHONES).alias("phone"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("category"), picked("c_custkey", DATES).alias("order_date"))
    return pipelines.clean(c).quality_after


@query
def pipeline_typed_engine(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), picked("c_custkey", ("10", "20.5", "none yet", "1,000")).alias("amount"))
    out, changes, cover = pipelines.typed_engine(c.select("*", F.col("c_custkey").cast("long").alias("_row_id")), ["amount"], [])
    return cover.select("cells_checked", "cells_modified")


@query
def pipeline_polish(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("copy"), F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderdate")
    out, _ = pipelines.polish(o, ["o_orderdate"], ["o_custkey"])
    return out.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query
def pipeline_clustering(spark, sf_dir):
    """Which spellings become which, and why."""
    c = table(spark, sf_dir, "customer").select(picked("c_custkey", DEVICES).alias("device"))
    return pipelines.clustering(c, "PERMISSIVE")[1].select("column", "old_value", "new_value", "method", F.round("score", 3).alias("score"))


# Further forms of operators.

BRANDS = ("red car", "red car", " red car", "car red ", "blue bike", "Blue Bike", "bike blue", "blue bike", "green boat")
SCRIPTS = ("ﬁne", "Ａ１", "café", "naïve №5", "سؤال", "plain")


@query
def detect_polish_columns(spark, sf_dir):
    """Columns that the last step before export takes for dates, and for numbers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("shipped"), F.lit("never").alias("birthday"), F.col("o_custkey").cast("string").alias("customer"), "o_orderdate", "o_totalprice")
    found = [(c, "date") for c in detect.polish_dates(o, ["o_orderkey"])] + [(c, "numeric") for c in detect.polish_numbers(o)]
    return spark.createDataFrame(found, "column string, kind string")


@query
def detect_engine_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("1,000", "2 500", "7", "8", "9.5", "6", "5", "4", "3", "none")).alias("mostly"), picked("c_custkey", ("1", "two")).alias("half"), picked("c_custkey", ("2024-02-03", "05/06/2021", "7 Feb 2022", "later")).alias("moment"))
    numbers, when = detect.engine_columns(c)
    return spark.createDataFrame([(c, "numeric") for c in numbers] + [(c, "date") for c in when], "column string, kind string")


@query
def detect_digits_and_letters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", F.col("c_custkey").cast("string").alias("key"), picked("c_custkey", ("12", "twelve")).alias("either"), picked("c_custkey", ("٣ كيلو", "-")).alias("arabic"))
    return spark.createDataFrame([(c,) for c in detect.digits_and_letters(c)], "column string")


@query
def detect_guides(spark, sf_dir):
    """Grouping columns by headers and by shares; the best group for a value."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_returnflag").alias("Category"), F.col("l_partkey").alias("item_id"), F.col("l_linestatus").alias("Product Name"))
    fine, coarse = detect.imputation_guides(li)
    return spark.createDataFrame([("fine", fine), ("coarse", coarse), ("phone", detect.phone_column(li.withColumn("Mobile No", F.lit("1"))))], "role string, column string")


@query
def schema_thresholds(spark, sf_dir):
    return schema.thresholded_types(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") * 1000).alias("wide"), "l_returnflag", F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("label")))


@query
def schema_downcast(spark, sf_dir):
    out = schema.downcast(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    return out.agg(F.first(F.typeof("l_orderkey")).alias("key_type"), F.first(F.typeof("l_linenumber")).alias("line_type"), F.first(F.typeof("l_quantity")).alias("quantity_type"), F.sum(F.col("l_orderkey").cast("long")).alias("keys"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))


@query
def schema_number_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(picked("c_custkey", ("10", "20.5", "none yet", "1,000", "?", "1 2", "")), F.lit("?")).alias("amount"))
    return schema.numbers_with_violations(c, ["amount"], ["c_custkey"])[0]


@query
def schema_number_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(picked("c_custkey", ("10", "20.5", "none yet", "1,000", "?", "1 2", "11", "12", "13", "14")), F.lit("?")).alias("amount"))
    return schema.numbers_with_violations(c, ["amount"], ["c_custkey"])[1]


@query
def impute_legacy_numbers(spark, sf_dir):
    out = impute.universal_legacy(dirty_orders(spark, sf_dir).drop("o_orderdate"), ["o_totalprice"], [], "o_custkey", "o_orderpriority", ["o_orderkey"], ["o_custkey"])
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.col("o_totalprice_imputation_status").alias("status"))


@query
def impute_legacy_categories(spark, sf_dir):
    out = impute.universal_legacy(dirty_orders(spark, sf_dir), [], ["o_orderstatus"], "o_custkey", "o_orderpriority", ["o_orderkey"], ["o_custkey"])
    return out.select("o_orderkey", "o_orderstatus", F.col("o_orderstatus_imputation_status").alias("status"))


@query
def impute_universal(spark, sf_dir):
    """Text in one form, categories by context, numbers by the best group."""
    out = impute.universal(dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority"), [], ["o_orderstatus"], "o_orderpriority", "o_orderpriority")
    return out.groupBy("o_orderstatus", F.col("o_orderstatus_imputation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def outlier_rows(spark, sf_dir):
    e = outliers.flag(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])
    return outliers.outlier_rows(e, 2**31 - 1)


@query
def audit_shifted(spark, sf_dir):
    before = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return audit.shifted(before, impute.sentinel_text(before, ["o_orderstatus", "o_orderpriority"]), ["o_orderkey"], ["o_orderpriority"])


@query
def audit_fixed_dates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("2024-02-03", "15/03/2020", "January 5, 2023", "soon", "")).alias("when"))
    return audit.fixed_dates(c, ["when"])


def _segments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, " furnitur").when(F.col("c_custkey") % 10 == 7, "furnitur").when(F.col("c_custkey") % 3 == 0, "machinery").otherwise("furniture").alias("segment"))


@query
def cluster_majority_blanks(spark, sf_dir):
    """Values with outer blanks; no row is lost or repeated."""
    return fuzzy.majority_words(_segments(spark, sf_dir), ["segment"])[0]


@query
def cluster_before_after(spark, sf_dir):
    c = _segments(spark, sf_dir)
    return fuzzy.before_after(c, fuzzy.majority_words(c, ["segment"])[1], "segment")


@query
def cluster_shown(spark, sf_dir):
    return fuzzy.shown(fuzzy.majority_words(_segments(spark, sf_dir), ["segment"])[1])


@query
def cluster_token_words(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", BRANDS).alias("label"))
    return fuzzy.token_set_harmonise(c, ["label"], normalise=F.lower)[0]


@query
def cluster_weighted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", DEVICES).alias("device"))
    return fuzzy.weighted_harmonise(c, ["device"])[0]


@query
def cluster_semantic_words(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", DEVICES).alias("device"))
    return fuzzy.harmonise(c, ["device"], V.preset("PERMISSIVE"))[0]


@query
def cluster_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(picked("c_custkey", DEVICES).alias("device"))
    return pipelines.clustering(c, "PERMISSIVE")[2]


@query
def text_forms_of_scripts(spark, sf_dir):
    v = picked("c_custkey", SCRIPTS)
    return table(spark, sf_dir, "customer").select("c_custkey", T.nfkc(v).alias("nfkc"), T.non_printing_dropped(F.concat(v, F.lit("\x07‏!"))).alias("shown"), T.python_title(F.concat(v, F.lit("'s o'neil"))).alias("title"))


@query
def export_report(spark, sf_dir):
    return writers.report_rows(dirty_orders(spark, sf_dir).select("o_orderstatus", "o_orderpriority", "o_totalprice"))


@query
def export_styles(spark, sf_dir):
    o = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice")
    gone = audit.cell_kinds(o, ["o_orderkey"], ["o_totalprice"], ["o_orderstatus"]).withColumn("kind", F.lit("missing"))
    return writers.style_map(o.select("o_orderkey", "o_orderstatus"), gone.where("column = 'o_orderstatus'"), ["o_orderkey"])


@query
def stream_windows(spark, sf_dir):
    """The counts that a stream of the events would end with."""
    w = streaming.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def headers_of_any_kind(spark, sf_dir):
    """Operators on columns whose names have dots, backticks and brackets."""
    o = dirty_orders(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("Status No."), F.col("o_orderpriority").alias("a`b"), F.col("o_totalprice").alias("Total [EUR]"))
    return profile.missing(impute.sentinel_text(o, ["Status No."]))


@query
def pipeline_second_engine(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", picked("c_custkey", ("10", "20.5", "none yet", "1,000", "11", "12", "13", "14")).alias("level"), picked("c_custkey", ("2024-02-03", "05/06/2021")).alias("moment"), picked("c_custkey", ("red car", "car red", "red car")).alias("label"))
    out, _ = pipelines.second_engine(c, ["c_custkey"])
    return out.select("c_custkey", "level", F.date_format("moment", "yyyy-MM-dd").alias("moment"), "label", "Notes")


def _clean_input(spark, sf_dir) -> DataFrame:
    """Customers with dirty cells of every kind; numbered by their keys."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("_row_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_custkey").cast("string").alias("total_price"), picked("c_custkey", ("+201012345678", "01012345678", "12345")).alias("phone"),
        picked("c_custkey", ("red car", "car red", " red car", "blue bike")).alias("goods"), F.when(F.col("c_custkey") % 4 != 3, picked("c_custkey", ("vehicle", "vehicle", "vehicle", "-"))).alias("category"), picked("c_custkey", ("2024-02-03", "15/03/2020", "soon")).alias("order_date"),
    )


@query
def pipeline_clean_data(spark, sf_dir):
    """The cleaned table of the whole run."""
    r = pipelines.clean(_clean_input(spark, sf_dir), pipelines.CleanOptions(outlier_columns=["total_price"]))
    return r.data.select(F.col("_row_id").alias("id"), "code", "total_price", "phone", "goods", "category", "order_date", F.col("__outlier__").alias("beyond"))


@query
def pipeline_clean_audit(spark, sf_dir):
    """Which cells the whole run changed."""
    r = pipelines.clean(_clean_input(spark, sf_dir), pipelines.CleanOptions(outlier_columns=["total_price"]))
    return r.audit.where("column <> 'total_price'").groupBy("column", "old_value", "new_value").agg(F.count(F.lit(1)).alias("n"))
