"""Texts in nested columns and JSON against a plain walk over the rows."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.plans import nested

SCHEMA = """id long, note string, who struct<name: string, age: int, mails: array<string>, home: struct<city: string>>,
tags map<string, array<struct<k: string, n: int>>>, codes map<int, string>, raw string, n double, odd struct<`a.b`: string>"""
ROWS = [
    (1, "top a@b.co", ("John", 3, ["x@y.org", None, "plain"], ("Paris",)), {"t": [("call 555-123-4567", 1), None], "u": None}, {7: "seven", 8: None},
     '{"k": 69, "deep": {"mail": "q@r.io", "l": ["s", {"z": "1.2.3.4"}, 5551234567, true, null]}, "e": [], "o": {}}', 1.0, ("dotted",)),
    (2, None, None, None, None, "no json: w@x.yz", None, None),
    (3, "", (None, None, [], None), {}, {}, '"just a text"', None, (None,)),
    (4, "x", ("y", 1, None, (None,)), {"only key": []}, {1: "one"}, '[["a", ["b", ["c"]]], {"a b.c": "d"}]', 2.0, ("",)),
]


def plain_walk(value, path, json_paths=(), numbers=False, found=None, parsed=False):
    found = [] if found is None else found
    if value is None or isinstance(value, bool):
        return found
    if isinstance(value, str):
        found.append((path, value))
    elif isinstance(value, dict) and parsed:
        for k, v in value.items():
            plain_walk(v, f"{path}.{k}", (), numbers, found, True)
    elif isinstance(value, list):
        for v in value:
            plain_walk(v, f"{path}[]", (), numbers, found, parsed)
    elif parsed and numbers:
        found.append((path, str(value)))
    return found


def expected(numbers=False):
    out = []
    for _, note, who, tags, codes, raw, _, odd in ROWS:
        plain_walk(note, "note", found=out)
        if who:
            plain_walk(who[0], "who.name", found=out)
            plain_walk(who[2], "who.mails", found=out)
            plain_walk(who[3][0] if who[3] else None, "who.home.city", found=out)
        for key, items in (tags or {}).items():
            plain_walk(key, "tags{key}", found=out)
            for item in items or []:
                plain_walk(item and item[0], "tags{}[].k", found=out)
        for value in (codes or {}).values():
            plain_walk(value, "codes{}", found=out)
        try:
            plain_walk(json.loads(raw), "raw", numbers=numbers, found=out, parsed=True)
        except ValueError:
            out.append(("raw", raw))
        plain_walk(odd and odd[0], "odd.a.b", found=out)
    return sorted(out)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("numbers", [False, True])
def test_every_text_has_its_path(frame, numbers):
    got = nested.text_leaves(frame, json_columns=["raw"], numbers=numbers).collect()
    assert sorted(tuple(r) for r in got) == expected(numbers)


def test_variants_anywhere(frame):
    inside = frame.select("id", F.array(F.struct(F.try_parse_json("raw").alias("v"))).alias("list"))
    got = nested.text_leaves(inside.where("id in (1, 4)"), keep=["id"]).collect()
    want = [(i, p.replace("raw", "list[].v", 1), v) for i, raw in ((1, ROWS[0][5]), (4, ROWS[3][5]))
            for p, v in plain_walk(json.loads(raw), "raw", parsed=True)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_deeper_levels_are_kept_as_text(spark):
    value = {"a": {"b": {"c": {"mail": "x@y.org"}}}, "t": "top"}
    frame = spark.createDataFrame([(json.dumps(value),)], "j string")
    got = {r["path"]: r["value"] for r in nested.text_leaves(frame, json_columns=["j"], max_depth=2).collect()}
    assert got == {"j.t": "top", "j.a.b": '{"c":{"mail":"x@y.org"}}'}
    profile = nested.path_profile(frame, json_columns=["j"], max_depth=2, entities=["EMAIL_ADDRESS"]).collect()
    assert [tuple(r) for r in profile] == [("j.a.b", "EMAIL_ADDRESS", 1, 1)]


def test_profile(frame):
    rows = nested.path_profile(frame, json_columns=["raw"], entities=["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"]).collect()
    assert {tuple(r) for r in rows} == {
        ("note", "EMAIL_ADDRESS", 1, 1), ("who.mails[]", "EMAIL_ADDRESS", 1, 1), ("tags{}[].k", "PHONE_NUMBER", 1, 1),
        ("raw.deep.mail", "EMAIL_ADDRESS", 1, 1), ("raw.deep.l[].z", "IP_ADDRESS", 1, 1), ("raw", "EMAIL_ADDRESS", 1, 1)}


def test_one_scan_of_needed_columns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = nested.path_profile(pages, json_columns=["props"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "event_type:string,props:string" in plan and "user_id" not in plan


def test_tables_without_texts_and_bad_names(spark):
    assert nested.text_leaves(spark.range(3)).collect() == []
    assert nested.text_leaves(spark.createDataFrame([], SCHEMA), json_columns=["raw"]).collect() == []
    with pytest.raises(ValueError, match="no such"):
        nested.text_leaves(spark.range(3), json_columns=["j"])
    with pytest.raises(ValueError, match="path"):
        nested.text_leaves(spark.range(3).withColumn("path", F.lit("x")), keep=["path"])
