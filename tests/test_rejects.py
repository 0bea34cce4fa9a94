"""Records that fail to parse: each rule, nulls, ties, repeats, long records, extra columns."""

from ostraka.operators import rejects

FILE, ERROR = "a/CTH 12_XML/KBx 1.xml", "mismatched tag: line 3, column 0"
CASES = {
    f'{FILE},"{ERROR}"': None,
    f'"{FILE}","{ERROR}"\r\n': None,
    f'{FILE},"{ERROR}"\n\n': "broken_quoting",
    f"{FILE},syntax error: line 1, column 2": "wrong_column_count",
    f'{FILE}, "{ERROR}"': "broken_quoting",
    f'{FILE}"x","{ERROR}"': "broken_quoting",
    f'"{FILE},"{ERROR}"': "broken_quoting",
    f'"a""b/CTH 1_XML/c.xml","{ERROR}"': None,
    f'"{FILE}"': "wrong_column_count",
    "": "wrong_column_count",
    None: "wrong_column_count",
    f'{FILE},"{ERROR}",': "wrong_column_count",
    f'a/CTH 012_XML/b.xml,"{ERROR}"': "invalid_value",
    f'a/CTH 0_XML/b.xml,"{ERROR}"': "invalid_value",
    f'/CTH 1_XML/b.xml,"{ERROR}"': "invalid_value",
    f'a/CTH 1_XML/.xml,"{ERROR}"': "invalid_value",
    f'a/CTH 1_XML/x/b.xml,"{ERROR}"': "invalid_value",
    f'a/CTH 1_XML/b\t.xml,"{ERROR}"': "invalid_value",
    f'a/CTH 1_XML/b�.xml,"{ERROR}"': "invalid_value",
    f'{FILE},"mismatched tag: line 0, column 0"': "invalid_value",
    f'{FILE},"mismatched tag: line 1, column 01"': "invalid_value",
    f'{FILE},"Mismatched tag: line 1, column 1"': "invalid_value",
    f'{FILE},"{ERROR} "': "invalid_value",
    '"' + "x," * 50_000 + '"': "wrong_column_count",
    '"' * 20_001: "broken_quoting",
}


def test_every_rule(spark):
    rows = [(i, r, "clash") for i, r in enumerate(CASES)]
    df = spark.createDataFrame(rows, "raw_id long, raw_record string, reason string")
    got = {r.raw_id: r.reason for r in rejects.judged(df).collect()}
    assert got == dict(enumerate(CASES.values()))
    assert {r.raw_id for r in rejects.rejected(df).collect()} == {i for i, v in got.items() if v}
    sound = {r.raw_id: (r.file, r.error) for r in rejects.loaded(df).collect()}
    assert sound[7] == ('a"b/CTH 1_XML/c.xml', ERROR)


def test_details_name_the_fault(spark):
    df = spark.createDataFrame([(1, f'a/CTH 0_XML/b.xml,"{ERROR}"'), (2, f'{FILE},"odd: line 1, column 1"')], "raw_id long, raw_record string")
    assert {r.raw_id: r.detail for r in rejects.judged(df).collect()} == {1: "file_composition", 2: "error_kind"}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "raw_id long, raw_record string")
    assert rejects.rejected(df).count() == 2
    assert rejects.rejected(df.limit(0)).count() == 0
