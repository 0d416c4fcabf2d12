"""Empty tables, nulls and repeats for the table, assembly, window and drawing operators."""

from pyspark.sql import functions as F

from assaylake.functions import decimals
from assaylake.operators import assemblers, matrices, observed, ruled, table_evidence, windows

EVIDENCE = "evidence_id string, source_id string, page int, table_id string, text_snippet string, source_type string, original_source_type string"
TABLES, CELLS, HEADERS = "table_id string, source_id string, page int, table_number string, caption string", "table_id string, row int, col int, text string", "table_id string, header_row int, col int, text string"
PAGES = "source_id string, page int, text string, origin string"


def test_decimal_keys(spark):
    cases = {
        "7.480 × 10-7": ["748e-9"], "7.48e-7 and 748": ["748e-9", "748e0"], "0.0 or 00.10": ["0", "1e-1"], "-5 x 10^3": ["-5e3"], "v2.5 3": ["3e0"], "": [], "1e99999999999999999999": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", decimals.decimal_keys(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == cases
    same = spark.createDataFrame([("1e-5", "10^-5 A"), ("100", "1E2"), ("0.10", "about 0.1"), ("5", "15"), ("x", "x"), (None, "1"), ("1", None)], "v string, t string")
    assert [bool(r[0]) for r in same.select(decimals.prints_value(F.col("t"), F.col("v"))).collect()] == [True, True, True, False, False, False, False]


def test_table_evidence(spark):
    tables = spark.createDataFrame([("t", "s", 1, "1", "Rates of steel")], TABLES)
    cells = spark.createDataFrame([("t", 0, 0, "Sample"), ("t", 0, 1, "Rate (mm/y)"), ("t", 1, 0, "bare steel"), ("t", 1, 1, "7.480e-7"), ("t", 2, 0, "coated"), ("t", 2, 1, "5"), ("t", 3, 0, None), ("t", 3, 1, "5")], CELLS)
    pages = spark.createDataFrame([("s", 1, "Rates of steel. The coated one was best of all here.", "native_text"), ("s", 2, None, "native_text")], PAGES)
    rows = [
        ("a", "s", 1, "t", "the rate of bare steel was 7.48 × 10−7", "table", "table_reported"), ("b", "s", None, "t", "coated 5", "table", "table_reported"), ("c", "s", 1, None, "rate 5 for coated samples", "table", "unknown"), ("d", "s", 1, "t", None, "table", "table_reported"),
        ("e", "s", None, None, "The coated one was best of all here.", "unknown", "unknown"), ("f", "s", 1, "t", "rate 5", "table", "table_reported"), ("g", "x", 1, "t", "coated", "table", "table_reported"), ("h", None, None, None, "z", None, None),
    ]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    verify = lambda e, c=cells: {r.evidence_id: (r.route, r.reason, r.locator) for r in table_evidence.verify_table_evidence(e, tables.drop("table_number"), c, spark.createDataFrame([], HEADERS), pages).collect()}
    assert verify(evidence) == {
        "a": ("stated_cell", None, "t:r1:c1"), "b": ("table_text", None, None), "c": ("recovered_cell", None, "t:r2:c1"), "d": (None, "empty_snippet", None),
        "e": ("page_text", None, None), "f": (None, "no_row_anchor", None), "g": (None, "unknown_table", None), "h": (None, "no_value", None),
    }
    assert verify(evidence.limit(0)) == {}
    assert verify(evidence.filter("evidence_id = 'a'"), cells.limit(0))["a"][1] == "no_value"


def test_matrices(spark):
    tables = spark.createDataFrame([("m", "s", 1, "1", "By temperature"), ("n", "s", 1, "2", None)], TABLES)
    cells = spark.createDataFrame([("m", 0, 0, "SOC"), ("m", 0, 1, "10 °C"), ("m", 0, 2, "25 °C"), ("m", 1, 0, "20 %"), ("m", 1, 1, "1.5"), ("m", 1, 2, "2"), ("m", 2, 0, "40 %"), ("m", 2, 1, "3"), ("m", 2, 2, "4"), ("n", 0, 0, None)], CELLS)
    pages = spark.createDataFrame([], PAGES)
    got = matrices.matrix_cells(tables, cells, pages)
    assert sorted((r.row, r.col, r.value, r.row_value, r.column_value) for r in got.collect()) == [(1, 1, 1.5, 20.0, 10.0), (1, 2, 2.0, 20.0, 25.0), (2, 1, 3.0, 40.0, 10.0), (2, 2, 4.0, 40.0, 25.0)]
    assert matrices.matrix_cells(tables, cells.limit(0), pages).count() == 0
    seeds = spark.createDataFrame([("p", "m", "g", "R", "Ω", 4.0, {"temperature": 25.0}, None, 1, "unknown")], "point_id string, table_id string, group_id string, property string, unit string, value double, axes map<string,double>, method string, cycle int, ownership string")
    assert [r.point_id for r in matrices.recover_matrices(got, seeds).orderBy("row", "col").collect()] == [None, None, None, "p"]
    assert [r.reason for r in matrices.table_bindings(got, seeds.limit(0)).collect()] == ["no_points"]


def test_assembly(spark):
    kind = "doc_id string, local_id string, ownership string, scope_status string, verified boolean, reason string"
    good = lambda i: ("d", i, "focal_work", "supported", True, None)
    materials = spark.createDataFrame([good("m"), ("d", "n", None, "supported", True, None), good("z"), good("z")], kind)
    treatments = spark.createDataFrame([(*good(f"t{i}"), ["m"], f"t{i - 1}" if i else None) for i in range(6)] + [(*good("u"), ["n"], "t5"), (*good("v"), ["z"], None), (*good("w"), None, "u")], f"{kind}, material_refs array<string>, base_ref string")
    out = assemblers.assemble({"materials": materials, "treatments": treatments}, assemblers.CORROSION)
    assert sorted(r.local_id for r in out["records"].collect()) == ["m", *(f"t{i}" for i in range(6))]
    assert {r.path: (r.level, r.reason) for r in out["quarantine"].collect()} == {
        "materials.n": (0, "ownership_unknown"), "materials.z": (0, "duplicate_local_id"), "treatments.u": (1, "refused_material"), "treatments.v": (1, "refused_material"), "treatments.w": (2, "refused_base"),
    }
    assert out["edges"].count() == 6 + 5
    empty = assemblers.assemble({"materials": materials.limit(0), "treatments": treatments.limit(0)}, assemblers.CORROSION)
    assert all(df.count() == 0 for df in empty.values())


def test_trees_of_support(spark):
    chain = [(f"r{i}", f"r{i - 1}" if i else None, "e" if i == 37 else None) for i in range(40)]
    records = spark.createDataFrame(chain, "record_id string, parent_id string, evidence_id string")
    got = {r.record_id: (r.support, r.steps) for r in table_evidence.propagate_support(records).collect()}
    assert got == {f"r{i}": ("e", 37 - i) if i <= 37 else (None, None) for i in range(40)}
    assert table_evidence.propagate_support(records.limit(0)).count() == 0


def test_windows(spark):
    text = "One  two. Three 5 mV!\n\nFour five? 6" + " x" * 3000 + ". Last"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "id int, text string")
    cut = windows.segments(docs, "id")
    rows = cut.orderBy("seq").collect()
    assert [text[r.start : r.end] for r in rows] == [r.segment for r in rows] and [r.segment[:5] for r in rows] == ["One  ", "Three", "Four ", "6 x x", "Last"]
    places = spark.createDataFrame([(1, len(text), "5 mV"), (1, 40, "5 mV"), (1, 40, "two"), (1, len(text), "x"), (2, 5, "x"), (1, 40, None)], "id int, at int, word string")
    got = {(r.at, r.word): r.support and r.support[:5] for r in windows.last_before(places, cut, "word").filter("id = 1").collect()}
    assert got[40, "5 mV"] == "Three" and got[40, "two"] == "One  " and got[len(text), "5 mV"] is None and got[40, None] is None
    assert windows.segments(docs.limit(0), "id").count() == 0


def test_drawn(spark):
    box = lambda x0, x1, y0, y1: [("t", True, float(x), float(y0), float(y1)) for x in (x0, x1)] + [("t", False, float(y), float(x0), float(x1)) for y in (y0, y1)]
    edges = spark.createDataFrame([*box(0, 20, 0, 10), *box(0, 10, 10, 20), *box(10, 20, 10, 20)], "table_id string, upright boolean, at double, low double, high double")
    assert sorted(tuple(r)[1:] for r in ruled.spanning_cells(edges).collect()) == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    assert ruled.spanning_cells(edges.limit(0)).count() == 0


def test_observed(spark):
    docs = spark.createDataFrame([(1, '{"catalysts":[{"local_id":"a","variant_of":"b"}],"stability_tests":"none"}'), (2, "[]"), (3, None)], "i int, t string").select(F.col("i").alias("id"), F.try_parse_json("t").alias("tree"))
    assert [tuple(r) for r in observed.dangling_references(docs, "id", "tree").collect()] == [(1, "catalysts[0].variant_of", "b")]
    assert observed.refused_metrics(docs, "id", "tree").count() == 0 == observed.expectations(docs, "id", "tree").count()
