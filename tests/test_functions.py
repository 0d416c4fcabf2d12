from pyspark.sql import functions as F

from assaylake.functions import identity, numbers, text


def values(spark, column, *inputs, kind="string"):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in t.orderBy("i").select(column(F.col("x"))).collect()]


def test_text_keys(spark):
    assert values(spark, text.scientific_key, "Al−Cu  µm", "25 ◦C", "photo-\nvoltaic", "STRASSE ß", None, "soft­hyphen", "“q”") == ["al-cu μm", "25 °c", "photovoltaic", "strasse ss", "", "softhyphen", '"q"']
    assert values(spark, text.evidence_key, "a\u0000b", "x²") == ["a b", "x2"]
    assert values(spark, text.slug, " Hello, World! ", "--", "Ünïcode") == ["hello-world", "unknown", "n-code"]
    assert values(spark, text.humanize, "specific_capacity", "rate_of_change", "the_END") == ["Specific Capacity", "Rate of Change", "The End"]
    assert values(spark, text.header_unit, "Temp (K)", "Rate [1/s] ", "plain") == ["K", "1/s", None]
    assert values(spark, text.csv_cell, "=1+1", "-5.2 V", "-x", None, "ok", "@a") == ["'=1+1", "-5.2 V", "'-x", "", "ok", "'@a"]
    assert values(spark, text.doi, "see https://doi.org/10.1000/ab.c1.", "none") == ["10.1000/ab.c1", None]
    assert values(spark, text.http_url, "https://a.b/c", "ftp://a.b", "x", None) == ["https://a.b/c", None, None, None]
    assert values(spark, text.sentences, "One. Two!\nThree") == [["One.", "Two!", "Three"]]
    assert values(spark, text.strip_fence, "```json\n{}\n```", "plain") == ["{}", "plain"]
    assert values(spark, text.redact, "api_key=abc123 x", "authorization: bearer zzz") == ["api_key=[REDACTED] x", "authorization: [REDACTED] [REDACTED]"]
    assert values(spark, lambda c: text.term_count(c, "eis"), "eis, EIS weis".lower(), "x") == [2, 0]
    assert values(spark, lambda c: text.term_score(c), 0, 1, 3, 50, kind="int") == [0.0, 1.0, 1.5, 2.0]
    assert values(spark, text.ocr_clean, "a\u0007b  c\n d ") == ["ab c\nd"]
    assert values(spark, text.is_missing, "N/A", " nr ", "5", None) == [True, True, False, True]


def test_pairs(spark):
    t = spark.createDataFrame([("the quick brown fox", "brown fox"), ("alpha beta gamma delta", "delta gamma beta alpha"), ("a b", "c d")], "a string, b string")
    assert [r[0] for r in t.select(text.snippet_overlap(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    t = spark.createDataFrame([("polyaniline (PANI)", "PANI"), ("Iron", "iron"), ("a (b)", "c")], "a string, b string")
    assert [r[0] for r in t.select(text.name_match(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    t = spark.createDataFrame([("A study of x", "a STUDY of x"), ("", "x")], "a string, b string")
    assert [r[0] for r in t.select(text.similarity_ratio("a", "b")).collect()] == [1.0, 0.0]


def test_numbers(spark):
    got = values(spark, numbers.scalar_condition, "25 °C", "C/10", "2-4 V", "text", "1e-3", " 5 ", None)
    assert [(r.value, r.unit) for r in got] == [(25.0, "°C"), (0.1, "C"), (None, None), (None, None), (1e-3, None), (5.0, None), (None, None)]
    got = values(spark, numbers.parse_quantity, "~1.5A", "24 °C", "<0.1 Hz", "≥ 3 V", "1.5–4.8 V", "none", "about 7 nm")
    assert [(r.value, r.unit, r.qualifier) for r in got] == [(1.5, "A", "approx"), (24.0, "°C", "exact"), (0.1, "Hz", "upper_bound"), (3.0, "V", "lower_bound"), (None, None, "range"), (None, None, "unknown"), (7.0, "nm", "approx")]
    got = values(spark, numbers.split_window, "1.5–4.8 V", "5 V")
    assert [(r.low, r.high) for r in got] == [("1.5 V", "4.8 V"), (None, None)]
    assert values(spark, numbers.reported_numbers, "1,250 and 3.2 × 10^-9", "x") == [[1250.0, 3.2, 10.0, -9.0, 3.2e-9], []]
    assert values(spark, lambda c: numbers.supports_value(c, F.lit(3.2e-9)), "3.2 × 10^-9 s", "3.3 × 10^-9 s") == [True, False]
    assert values(spark, numbers.unit_key, "MPa ", "J·m²", None) == ["mpa", "j*m2", ""]
    t = spark.createDataFrame([(2.0, "min"), (5.0, "ms"), (3.0, "ppb"), (20.0, "°C"), (1.0, "kg")], "v double, u string")
    assert [tuple(r) for r in t.select(*numbers.sensor_units(F.col("v"), F.col("u"))).collect()] == [(120.0, "s"), (0.005, "s"), (0.003, "ppm"), (20.0, "°C"), (None, None)]
    assert values(spark, numbers.corrosion_category, "mm per yr", "mg cm−2 h−1", "g/cm²", "%", None, "blorp", "hours", "kg/m^3") == ["penetration_rate", "mass_loss_rate", "mass_per_area", "percent", "unknown", "unknown", "time", "density"]
    t = spark.createDataFrame([(50.0,)], "p double").select(numbers.pixel_to_data(F.col("p"), F.lit(0.0), F.lit(100.0), F.lit(1.0), F.lit(100.0), True))
    assert abs(t.first()[0] - 10) < 1e-9
    assert values(spark, lambda c: numbers.round_to_uncertainty(c, F.lit(0.03)), 1.23456, kind="double") == [1.23]


def test_identity(spark):
    t = spark.createDataFrame([("a", None), ("a", ""), ("b", "c")], "x string, y string")
    ids = [r[0] for r in t.select(identity.stable_id("p", F.col("x"), F.col("y"))).collect()]
    assert ids[0] == ids[1] != ids[2] and all(i.startswith("p-") and len(i) == 18 for i in ids)


def test_bare_credentials_are_redacted(spark):
    key = "AIza" + "b" * 24
    assert values(spark, text.redact, "got Bearer abc.def-1 back", f"see {key} there", "token: 'x'") == ["got Bearer [REDACTED] back", "see [REDACTED_GOOGLE_API_KEY] there", "token: 'x'"]


def test_safe_identifiers(spark):
    assert values(spark, text.safe_identifier, "a/b-1.csv", "/etc/x", "a/../b", "a:b", "a" * 128, "a" * 129, "a b", "", "x\n") == ["a/b-1.csv", None, None, None, "a" * 128, None, None, None, None]


def test_dois_and_prose(spark):
    assert values(spark, text.doi, "doi:10.1234/ab.c(1)).", "10.12/x", "see 10.5555/x;") == ["10.1234/ab.c(1", None, "10.5555/x"]
    assert values(spark, text.looks_like_prose, "one two three four five six seven eight.", "one two three four five six seven eight", "1 2 3 4 5 6 7 8 abcdefghijklmn.", "short text.", None) == [True, False, False, False, False]


def test_items_are_trimmed_of_blanks_only(spark):
    assert values(spark, lambda c: F.concat_ws("|", text.sentences(c)), "0 at first. 1 then. 2 at last") == ["0 at first.|1 then.|2 at last"]
