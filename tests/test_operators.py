"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from cleanloom import vocabulary as V
from cleanloom.operators import audit, detect, fuzzy, impute, outliers, profile, rows, schema
from cleanloom.plans import pipelines


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_scores():
    assert fuzzy.ratio("table", "tabel") == 80
    assert fuzzy.token_set_ratio("new york mets", "mets new york") == 100
    assert fuzzy.weighted_ratio("", "x") == 0
    assert fuzzy.edit_distance("kitten", "sitting") == 3
    assert fuzzy.common_length("abcbdab", "bdcaba") == 4
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100


def test_keyword_headers():
    assert detect.header_has("Order_Date", V.DATE_HEADERS) and not detect.header_has("l_linenumber", V.PHONE_HEADERS) and not detect.header_has("hotel", V.PHONE_HEADERS) and not detect.header_has("paid", V.ID_HEADERS)


def test_dedupe_and_changes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "i int, k string, v int")
    assert values(rows.drop_duplicates(df, ["i"], ["k", "v"]), "i") == [(1,), (3,)]
    after = df.withColumn("v", F.coalesce("v", F.lit(9)))
    assert values(rows.changed_cells(df, after, ["i"]), "i", "column", "new_value") == [(1, "v", "9"), (2, "v", "9")]
    assert rows.changed_cells(df, df, ["i"]).count() == 0


def test_hierarchical_median(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("a", "x", None), ("b", "x", None), ("c", "y", None), ("a", "x", 20.0), ("d", None, None)], "f string, c string, v double")
    got = impute.hierarchical_median(df, "v", "f", "c")
    assert values(got, "f", "v", "v_imputation_status") == [
        ("a", 10.0, "Original Value"), ("a", 15.0, "Filled by Item Context"), ("a", 20.0, "Original Value"), ("b", 15.0, "Filled by Category Context"), ("c", 15.0, "Filled by Global Median"), ("d", 15.0, "Filled by Global Median"),
    ]
    with pytest.raises(KeyError):
        impute.hierarchical_median(df, "v", "f", "missing")


def test_order_without_a_key(spark):
    """Ranges of the order give what one window over all rows gives."""
    from pyspark.sql import Window

    df = spark.createDataFrame([(i * 7 % 200, float(i) if i % 9 == 0 else None, f"g{i % 3}", None if i % 5 else "x") for i in range(200)], "i int, v double, g string, h string").repartition(3)
    w = Window.orderBy("i")
    plain = F.coalesce(F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    assert values(rows.carried(df, "v", ["i"]), "i", "v") == values(df.withColumn("v", plain), "i", "v")
    near = F.coalesce("v", F.lag("v").over(w), F.lead("v").over(w))
    assert values(rows.neighbour(df, "v", ["i"]), "i", "v") == values(df.withColumn("v", near), "i", "v")
    one = lambda f: F.when(f(F.col("g")).over(w).eqNullSafe(F.col("g")), f(F.col("v")).over(w))
    assert values(rows.neighbour(df, "v", ["i"], same=["g"]), "i", "v") == values(df.withColumn("v", F.coalesce("v", one(F.lag), one(F.lead))), "i", "v")
    some = lambda f: F.when(F.coalesce(f(F.col("h")).over(w) == F.col("h"), F.lit(False)) | (f(F.col("g")).over(w) == F.col("g")), f(F.col("v")).over(w))
    assert values(rows.neighbour(df, "v", ["i"], any_of=["g", "h"]), "i", "v") == values(df.withColumn("v", F.coalesce("v", some(F.lag), some(F.lead))), "i", "v")
    assert rows.carried(df.limit(0), "v", ["i"]).count() == 0


@pytest.mark.parametrize("few,accuracy", [(5_000_000, 10_000), (0, 10_000), (0, 50)])
def test_quantiles_of_any_size(spark, monkeypatch, few, accuracy):
    """The counted way gives just what Spark's aggregate gives."""
    import random

    from cleanloom.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW_ROWS", few)
    monkeypatch.setattr(quantiles, "FEW_BYTES", few)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(3)
    data = [("hot", rng.choice([7.0, rng.random() * 100])) for _ in range(3000)] + [(rng.choice(["a", "b", None]), rng.randrange(9) / 4) for _ in range(200)] + [("empty", None), ("one", 4.5), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    shares = [0.0, 0.2, 0.25, 0.5, 0.75, 1.0]
    got = {r["__k0"]: (r["__q"], r["__n"]) for r in quantiles.quantiles(df, F.col("v"), shares, [F.col("g")]).collect()}
    want = {r["g"]: (r["q"], r["n"]) for r in df.groupBy("g").agg(F.percentile("v", shares).alias("q"), F.count("v").alias("n")).collect()}
    assert got == want
    assert quantiles.medians(df, F.col("v"), "m").first()["m"] == df.agg(F.median("v")).first()[0]
    assert quantiles.medians(df.where("g = 'empty'"), F.col("v"), "m").collect()[0]["m"] is None
    assert {r["__k0"]: r["m"] for r in quantiles.modes(df, F.col("v"), "m", [F.col("g")]).collect()} == {r["g"]: r["m"] for r in df.groupBy("g").agg(F.mode("v", True).alias("m")).where("m IS NOT NULL").collect()}
    assert quantiles.modes(df.limit(0), F.col("v"), "m").collect()[0]["m"] is None


def test_waterfall_keeps_all_null(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", None)], "i int, f string, c string, v double")
    assert values(impute.median_waterfall(df, "v", "f", "c", ["i"]), "i", "v") == [(1, None), (2, None)]


def test_siblings_and_descriptions(spark):
    df = spark.createDataFrame([(1, "Milk", None, "fresh"), (2, "milk!", "Dairy", ""), (3, "Bun", None, "a bakery thing"), (4, "x", "Bakery", ""), (5, "q", None, "none")], "i int, item string, cat string, notes string")
    got = impute.text_by_siblings(df, "cat", ["item"], ["notes"])
    assert values(got, "i", "cat", "cat_predicted") == [(1, "Dairy", True), (2, "Dairy", False), (3, "Bakery", True), (4, "Bakery", False), (5, V.SENTINEL, False)]


def test_modes_take_smallest_of_ties(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), (None, "z"), (None, None)], "a string, v string")
    got = impute.categorical_by_context(df, ["v"], ["a"])
    assert values(got, "a", "v") == [("k", "a"), ("k", "a"), ("k", "b"), (None, "z"), (None, "z")]


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(99, 1000.0)], "i int, v double")
    assert values(outliers.coordinates(df, ["i"], ["v"]), "i") == [(99,)]
    assert outliers.coordinates(df.limit(3), ["i"], ["v"]).count() == 0
    flat = spark.createDataFrame([(1, 5.0)] * 8 + [(2, 9.0)], "i int, v double")
    assert outliers.coordinates(flat, ["i"], ["v"]).count() == 0


def test_empty_cells_before_export(spark):
    df = spark.createDataFrame([("null", ""), ("NULL", "null"), ("N/A", "x"), ("n/a", None), ("7", "y")], "q string, t string")
    assert values(schema.standard_empty(df, ["q"]), "q", "t") == sorted([(None, None), (None, "null"), (None, "x"), ("n/a", None), ("7", "y")], key=str)


def test_first_description_that_names_a_value(spark):
    df = spark.createDataFrame([(1, "Zinc", "", ""), (2, "Amber", "", ""), (3, None, "made of zinc", "an amber tone"), (4, None, "nothing", "an amber tone"), (5, None, None, None)], "i int, c string, a string, b string")
    assert values(impute.text_by_siblings(df, "c", [], ["a", "b"]), "i", "c") == [(1, "Zinc"), (2, "Amber"), (3, "Zinc"), (4, "Amber"), (5, V.SENTINEL)]


def test_financial_headers():
    assert all(map(detect.is_financial, ["totalprice", "o_totalprice", "l_extendedprice", "unitprice", "Net Amount", "إجمالي الطلب"])) and not detect.is_financial("city")


def test_coverage(spark):
    df = spark.createDataFrame([(1, "a", "b")] * 4, "_row_id int, x string, y string")
    assert audit.coverage(df, df.limit(1), ["x"]).first().asDict() == {"cells_checked": 4, "cells_modified": 1, "coverage_pct": 50.0}


def test_relations(spark):
    df = spark.createDataFrame([(float(i), 2.0 + i % 3, None if i == 3 else 99999.0 if i == 40 else i * (2.0 + i % 3)) for i in range(1, 60)], "a double, b double, c double")
    assert ("a", "b", "c") in values(outliers.products(df, ["a", "b", "c"]), "a", "b", "c")
    fixed = outliers.repair_products(df, [("a", "b", "c")])
    assert values(fixed.where("a in (3, 40)"), "c", "c_calculation_status") == [(120.0, "Corrected"), (6.0, "Calculated")]


def test_columns(spark):
    df = spark.createDataFrame([("1", "1", "x", 1.0), ("23", "23", None, 2.0), (None, None, "x", None)], "a string, b string, c string, d double")
    assert schema.duplicate_columns(df) == ["b"]
    assert schema.integral(df, ["d"]).schema["d"].dataType.typeName() == "long"
    price = spark.createDataFrame([("100", "100"), ("200", "invalid"), (None, "300")], "price string, amount string")
    out = schema.strict_numeric(price)
    assert out.schema["price"].dataType.typeName() == "double" and out.schema["amount"].dataType.typeName() == "string"


def test_clustering(spark):
    df = spark.createDataFrame([(x,) for x in ["common"] * 5 + ["commun"] * 3 + ["comon"] * 2 + ["rare", None, " rare "]], "v string")
    out, mapping = fuzzy.harmonise(df, ["v"], V.preset("PERMISSIVE"))
    assert out.where("v = 'common'").count() == 10 and out.where("v = 'rare'").count() >= 1
    many = spark.createDataFrame([(f"id_{i}",) for i in range(600)], "v string")
    assert fuzzy.semantic_mapping(many, "v") == []
    assert V.preset("nothing") is V.PRESETS["BALANCED"] and V.recommended("ocr").fuzzy_threshold == 75


def test_outer_blanks_and_row_counts(spark):
    df = spark.createDataFrame([(x,) for x in ["furniture"] * 4 + ["furnitur", " furnitur", "furnitur ", None, "", "machinery"]], "v string")
    out, _ = fuzzy.majority_words(df, ["v"])
    assert out.count() == 10 and out.where("v = 'furniture'").count() == 7
    cars = spark.createDataFrame([(x,) for x in ["red car", "red car", " red car", "car red ", "Car  RED", "blue", None]], "v string")
    out, mapping = fuzzy.token_set_harmonise(cars, ["v"], normalise=lambda c: F.lower(c))
    assert sorted(str(r[0]) for r in out.collect()) == ["None", "blue", *["red car"] * 5]
    assert fuzzy.apply_mapping(df, [("v", " furnitur", "a", "m", 1.0), ("v", "furnitur ", "a", "m", 1.0)]).count() == 10


def _in_turn(values, threshold):
    """Leader and score of each value by the plain rule: all leaders before it are scored in turn."""
    out = {}
    for v in values:
        got = ((a, fuzzy.token_set_ratio(a, v)) for a, (b, _) in list(out.items()) if a == b)
        out[v] = next((x for x in got if x[1] >= threshold), (v, 100.0))
    return out


def test_token_sets_score_few_and_miss_none(spark, monkeypatch):
    codes = [f"Customer#{i:09d}" for i in range(0, 40_000, 13)]
    df = spark.createDataFrame([(c,) for c in codes], "v string")
    scored, plain = [], fuzzy.token_set_ratio
    monkeypatch.setattr(fuzzy, "token_set_ratio", lambda a, b: scored.append(1) or plain(a, b))
    found = fuzzy.token_set_mapping(df, ["v"])
    assert len(scored) < 3 * len(codes)
    monkeypatch.undo()
    led = _in_turn(codes, 90)
    assert [(m[1], m[2], m[4]) for m in found] == [(v, a, s) for v, (a, s) in led.items() if v != a]
    # Whatever may be looked up, and whatever must be counted.
    words = ["red car", "car red", "red", "red cars", "green boat of wood", "green boat of woods", "boat of wood", "wooden", "wodden", "Ａé😀 x", "Ａé x", "x", "a" * 300, "a" * 299 + "b", "ab " * 3 + "abc", "abcd", "bacd", "new york mets", "mets new york", " "]
    for threshold in (50, 80, 90, 99, 100, 101, 0):
        for most, in_all in ((500, 2_000_000), (0, 10), (500, 3)):
            monkeypatch.setattr(fuzzy.TokenSetLeaders, "MOST", most)
            monkeypatch.setattr(fuzzy.TokenSetLeaders, "MOST_IN_ALL", in_all)
            assert fuzzy._leaders(words, threshold) == [v for v, (a, _) in _in_turn(words, threshold).items() if v == a]
            known, led = fuzzy._known(fuzzy._leaders(words, threshold), threshold), _in_turn(words, threshold)
            assert all((known.values[f[0]] if (f := known.first(w)) else w) == led[w][0] for w in words)


def test_clean_of_many_spellings(spark, monkeypatch):
    """As many jobs whatever the number of spellings is, in rounds as at once; the audit tells each that the plain rule unifies."""
    labels = [f"Consignment {i * 7919 % 10**5:05d}" for i in range(1600)]
    df = spark.createDataFrame(list(enumerate(labels)), "n long, label string")  # equal rows would go
    told, plain = [], fuzzy.tables.written
    monkeypatch.setattr(fuzzy.tables, "written", lambda df, name, *a: told.append(name) or plain(df, name, *a))
    audit_of = lambda: pipelines.clean(df, pipelines.CleanOptions(normalise=False, impute=False, impute_text=False)).audit
    expected = sorted((v, a) for v, (a, _) in _in_turn(sorted(labels), 90).items() if v != a)
    assert expected and sorted((r["old_value"], r["new_value"]) for r in audit_of().collect()) == expected
    assert "values" not in told
    monkeypatch.setattr(fuzzy, "TAKEN", 700)
    assert sorted((r["old_value"], r["new_value"]) for r in audit_of().collect()) == expected
    assert 1 <= told.count("values") <= 2


def test_clean_of_one_file_takes_all_tasks(spark, tmp_path, monkeypatch):
    """A table of one file is dealt out, only open headers are read as dates, few spellings need no Python worker, and quality waits until asked for; results are as ever."""
    days = ("2024-02-03", "15/03/2020", "soon")
    df = spark.createDataFrame([(i, f"C{i}", ("red car", "car red", " red car", "blue bike")[i % 4], days[i % 3], days[i % 2], f"m{i % 2}@x.org") for i in range(40)], "n long, code string, goods string, order_date string, moment string, mail string")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    assert df.rdd.getNumPartitions() == 1
    kinds, (when, personal) = detect.types(df), detect.dates_and_personal(df)
    assert when == [c for c in df.columns if kinds[c]["date"]] == ["order_date", "moment"] and personal == {c: kinds[c]["pii"] for c in rows.text_columns(df)}
    parts, plain = {}, fuzzy.tables.written

    def written(frame, name, *a):
        out = plain(frame, name, *a)
        parts[name] = out.rdd.getNumPartitions()
        return out

    monkeypatch.setattr(fuzzy.tables, "written", written)
    asked, quality = [], profile.quality
    monkeypatch.setattr(profile, "quality", lambda d: asked.append(1) or quality(d))
    workers = []
    monkeypatch.setattr(fuzzy, "_led", lambda *a: workers.append(1))
    r = pipelines.clean(df)
    assert parts["clean-input"] == spark.sparkContext.defaultParallelism > 1 and not workers and not asked
    assert values(r.audit.where("column = 'goods'").groupBy("old_value", "new_value").count(), "old_value", "new_value", "count") == [(" red car", "Red Car", 10), ("blue bike", "Blue Bike", 10), ("car red", "Red Car", 10), ("red car", "Red Car", 10)]
    assert r.data.count() == 40 and r.data.where("moment NOT IN ('2024-02-03', '2020-03-15')").isEmpty()
    assert r.quality_after.first()["score"] >= r.quality_before.first()["score"] and len(asked) == 2


def test_few_spellings_as_many(spark, monkeypatch):
    """The driver's way with few values and the workers' way give the same mappings."""
    names = ["furniture"] * 3 + ["furnitur", " furniture", "chair oak", "oak chair", "oak chairs", "machinery", "machinary", "Nan"]
    df = spark.createDataFrame([(v, v.upper() if i % 3 else None) for i, v in enumerate(names)], "a string, b string")
    both = lambda: (fuzzy.token_set_mapping(df, ["a", "b"]), fuzzy.majority_mapping(df, ["a", "b"]))
    few = both()
    monkeypatch.setattr(fuzzy, "_few", lambda values: None)
    assert few == both() and all(few)


def test_clean_leaves_codes_apart(spark):
    """Codes C10006 and C1000 are alike as spellings, but identifiers are none; names beside them are unified."""
    df = spark.createDataFrame([("C1000", "red lorry"), ("C10006", "lorry red"), ("C10009", "red lorry"), ("C1000", "blue boat")], "code string, goods string")
    r = pipelines.clean(df)
    assert sorted(tuple(x) for x in r.data.select("code", "goods").collect()) == [("C1000", "Blue Boat"), ("C1000", "Red Lorry"), ("C10006", "Red Lorry"), ("C10009", "Red Lorry")]
    assert "code" not in {x["column"] for x in r.audit.collect()}


def test_no_bound_on_distinct_values(spark):
    rare = spark.createDataFrame([("acceptable",)] * 3 + [(f"a{i:05d}",) for i in range(10_050)] * 2 + [("zcceptable",)], "v string")
    assert ("v", "zcceptable", "acceptable") in [m[:3] for m in fuzzy.majority_mapping(rare, ["v"])]
    far = lambda i: "".join(chr(97 + int(c)) * 2 for c in f"{i * 7919 % 10**6:06d}")
    names = spark.createDataFrame([(far(i),) for i in range(1050)] * 2 + [("zebra crossings north",), ("zebra crossing north",)], "v string")
    assert ("v", "zebra crossings north", "zebra crossing north") in [m[:3] for m in fuzzy.name_mapping(names, "v")]
    phones = spark.createDataFrame([(f"+{i * 7_654_321 % 10**11:011d}",) for i in range(1050)] * 2 + [("+999999999999999999998",), ("+99999999999999999999",)], "v string")
    assert ("v", "+999999999999999999998", "+99999999999999999999") in [m[:3] for m in fuzzy.phone_mapping(phones, "v")]
    codes = spark.createDataFrame([(f"m{i:05d}",) for i in range(600)] + [("zzy",), ("zzx",)], "v string")
    assert [tuple(r) for r in fuzzy.short_pairs(codes, "v").collect()] == [("zzx", "zzy", 1)]


def test_chronology(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-02-01"), (2, "2024-03-01", "2024-02-01")], "i int, a string, b string")
    out, anomalies = audit.clean_dates(df, ["a", "b"], ["i"], 2025, ["a", "b"])
    assert values(out, "i", "is_chronology_invalid") == [(1, False), (2, True)]
    assert values(anomalies, "i", "action_taken") == [(2, "Chronology Invalid")]
    with pytest.raises(ValueError):
        audit.clean_dates(df, ["z"], ["i"], 2025)


def test_profile_and_quality(spark):
    df = spark.createDataFrame([(1, "a", "5"), (2, None, "6"), (2, None, "6")], "i int, t string, n string")
    q = profile.quality(df).first()
    assert q["missing"] == pytest.approx(2 / 9) and q["duplicates"] == pytest.approx(1 / 3) and q["numbers_as_text"] == pytest.approx(1 / 3)
    assert {r["column"]: r["null_count"] for r in profile.missing(df).collect()} == {"i": 0, "t": 2, "n": 0}
    assert profile.quality(df.limit(0)).first()["score"] == 0.0


def test_headers_of_any_kind(spark):
    df = spark.createDataFrame([("1", "x", None, "p"), ("1", "x", None, "p"), ("2", None, 4.0, "q"), ("3", "y", 5.0, "q")], ["No.", "a`b", "Sum [EUR]", "column"])
    assert {r["column"] for r in detect.evidence(df).collect()} == set(df.columns)
    assert schema.duplicate_columns(df.withColumn("Nr.", F.col("`No.`"))) == ["Nr."]
    assert profile.quality(df).first()["duplicates"] == 0.25
    assert {r["column"]: r["null_count"] for r in profile.missing(df).collect()} == {"No.": 0, "a`b": 1, "Sum [EUR]": 2, "column": 0}
    out = impute.hierarchical_median(df, "Sum [EUR]", "a`b", "No.")
    assert out.columns[:4] == df.columns and out.where("`Sum [EUR]` IS NULL").count() == 0
    r = pipelines.clean(df)
    assert r.data.columns[:4] == df.columns and r.data.count() == 3 and {x["column"] for x in r.audit.collect()} <= set(df.columns)


def test_pipelines(spark):
    df = spark.createDataFrame([("Ann Lee", "+201012345678", "2024-01-02", "10", "A"), ("Bob Ray", "966512345678", "03/04/2023", None, "A"), ("Bob Ray", "966512345678", "03/04/2023", None, "A"), ("Cid Fox", "", "bad", "30", "B")], "name string, phone string, order_date string, amount string, category string")
    r = pipelines.clean(df)
    assert r.data.count() == 3 and r.audit.count() > 0 and r.quality_after.first()["score"] >= r.quality_before.first()["score"]
    assert r.data.where("amount IS NULL").count() == 0
    lib = pipelines.clean_library(df)
    assert lib.data.count() == 4
    out, info = pipelines.polish(df.withColumn("copy", F.col("amount")), ["order_date"], ["amount"])
    assert info["dropped"] == ["copy"] and out.schema["amount"].dataType.typeName() == "long" and out.where("System_Notes <> ''").count() == 1


def test_files(spark, tmp_path):
    from cleanloom.sources import readers, writers

    path = tmp_path / "in.csv"
    path.write_bytes("name , city\nعلي,القاهرة\nx,N/A\n".encode("cp1256"))
    df = readers.read(spark, str(path))
    assert df.columns == ["name", "city"] and values(df, "name", "city") == [("x", None), ("علي", "القاهرة")]
    utf = tmp_path / "u.csv"
    utf.write_bytes("a,b\n1,\n".encode("utf-8-sig"))
    assert values(readers.read(spark, str(utf)), "a", "b") == [("1", None)]
    writers.csv_with_mark(df, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    with pytest.raises(ValueError):
        readers.read(spark, "book.doc")
    kinds = pipelines.file_to_file(spark, str(utf), str(tmp_path / "done"))
    assert kinds["a"] == "numeric" and spark.read.parquet(str(tmp_path / "done/data")).count() == 1


def test_workbooks(spark, tmp_path):
    import zipfile

    from cleanloom.sources import readers, writers, xlsx

    df = spark.createDataFrame([(1, "علي & <b>", 2.5, None), (2, None, 3.0, "N/A")], "id int, `No.` string, v double, w string")
    kinds = spark.createDataFrame([(1, "v", "outlier"), (1, "v", "missing"), (2, "No.", "missing")], "id int, column string, kind string")
    path = str(tmp_path / "book.xlsx")
    writers.write_xlsx(path, df, kinds, ["id"], {"audit": kinds}, formats={"v": "#,##0.00"})
    got = readers.read(spark, path)
    assert got.columns == df.columns and values(got, "id", "`No.`".strip("`"), "v", "w") == [("1", "علي & <b>", "2.5", None), ("2", None, "3.0", None)]
    with zipfile.ZipFile(path) as z:
        sheet, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
        assert 'rightToLeft="1"' in sheet and 'state="frozen"' in sheet and "#,##0.00" in styles and xlsx.FILLS["outlier"] in styles and xlsx.FILLS["missing"] in styles
    assert sorted(xlsx.read_rows((tmp_path / "book.xlsx").read_bytes(), 1)) == [["1", "v", "missing"], ["1", "v", "outlier"], ["2", "No.", "missing"], ["id", "column", "kind"]]
    assert [xlsx._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and xlsx._place("AAA7") == 702


def test_duplicate_headers(spark, tmp_path):
    from cleanloom.sources import readers

    (tmp_path / "d.csv").write_bytes("a, a,ب\n1,2,3\n".encode("cp1256"))
    df = readers.read(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["a", "a.1", "ب"] and [tuple(r) for r in df.collect()] == [("1", "2", "3")]


def test_encoding_from_all_bytes(spark, tmp_path):
    from cleanloom.sources import readers

    late = tmp_path / "late.csv"
    late.write_bytes(b"a,b\n" + b"xxxxxxx,y\n" * 120_000 + "علي,z\n".encode("cp1256"))
    assert readers.read(spark, str(late)).where("a = 'علي'").count() == 1
    mixed = tmp_path / "mixed.csv"
    mixed.mkdir()
    (mixed / "1.csv").write_bytes(b"a,b\nx,y\n")
    (mixed / "2.csv").write_bytes("a,b\nعلي,z\n".encode("cp1256"))
    (mixed / "3.csv").write_bytes("a,b\nمنى,w\n".encode())
    assert values(readers.read(spark, str(mixed)), "a", "b") == [("x", "y"), ("علي", "z"), ("منى", "w")]


def test_stream(spark, tmp_path):
    from cleanloom import streaming

    batch = spark.createDataFrame([(1.0, "apple"), (3.0, "apple"), (None, "aple apple")], "v double, k string")
    fitted = streaming.fit(batch, ["v"], ["k"])
    batch.write.parquet(str(tmp_path / "s"))
    stream = fitted.transform(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "s")))
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert values(spark.table("cleaned"), "v", "k") == [(1.0, "apple"), (2.0, "apple"), (3.0, "apple")] or spark.table("cleaned").where("v IS NULL").count() == 0


def test_entry_names(spark):
    import __spark_entry__ as e

    known = e.queries()
    assert set(e.oracle_sql()) <= set(known) and len(known) > 60
    assert e.entry(spark).count() > 0
