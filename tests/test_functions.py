import hashlib
import json
import random

import pytest
from factloom.functions import scalars as S
from factloom.functions.canonical import canonical, jcs, nesting, path_exists, snapshot_matches, strict_json_code, strict_object
from pyspark.sql import functions as F


def one(spark, values, f, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_formats(spark):
    assert one(spark, ["A" * 64, "g" * 64, "a" * 63, "a" * 64 + "\n", None], S.is_sha256) == [True, False, False, False, False]
    assert one(spark, ["1.50", "-0", "01", "1e3", " 1", "1.", "", None, "9" * 101, "1\n"], S.is_decimal_text) == [True, True] + [False] * 8
    assert one(spark, ["0.00", "12.3", "-1.00", "1" * 16 + ".00"], S.is_amount_cny) == [True, False, False, False]
    assert one(spark, ["a/b", "a//b", "../a", "a/../b", "/a", "", ".", "a\\b", None, "a..b"], S.is_safe_relative_path) == [True, True, False, False, False, False, False, False, False, True]
    assert one(spark, ["a/b", "a\0", "./.", "/", None], S.is_portable_path) == [True, False, False, False, False]
    assert [x and x.isoformat() for x in one(spark, ["2024-02-29T01:02:03Z", "2024-02-30T01:02:03Z", "2024-02-29T01:02:03.000001Z", "2024-02-29T01:02:03+00:00", None], S.utc_timestamp)] == ["2024-02-29T01:02:03", None, "2024-02-29T01:02:03.000001", None, None]
    assert one(spark, ["https://A.example/x?y", "http://a.example", "https://u:p@a.example/", "https://a.example:444/", "https://a.example:443", "https://a.example/#f", None, "https://a/" + "x" * 2048], S.url_host) == ["a.example", None, None, None, "a.example", None, None, None]
    kinds = [("DATE", "2024-02-30", "NONE"), ("DATE", "2024-02-29", "TERMINATION"), ("AMOUNT_CNY", "1.00", "NONE"), ("AMOUNT_CNY", "1.00", "TERMINATION"), ("SUBJECT_KEY", "ABC", "NONE"), ("X", "ABC", "NONE"), (None, None, None)]
    df = spark.createDataFrame(kinds, "k string, v string, r string").select(S.is_canonical_value(F.col("k"), F.col("v"), F.col("r")).alias("y"))
    assert [r.y for r in df.collect()] == [False, True, True, False, True, False, False]


def test_media_types(spark):
    wide = "é".encode()
    cases = [b"%PDF-1", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff1", b"GIF89a", b"PK\x03\x04", b"\x1f\x8b", b"MZ", b"", b"plain", b"a\0b", b"\xff\xfe", b"a" * 8191 + wide, b"a" * 8190 + wide + b"\xff", None]
    want = ["application/pdf", "image/png", "image/jpeg", "image/gif", "application/zip", "application/gzip", "application/vnd.microsoft.portable-executable", "text/plain", "text/plain"] + ["application/octet-stream"] * 3 + ["text/plain", "application/octet-stream"]
    assert one(spark, cases, S.media_type, "binary") == want


def test_raw_id_and_lines(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    want = "RAW-" + hashlib.sha256("a/文".encode() + b"\0" + bytes.fromhex(digest)).hexdigest()
    df = spark.createDataFrame([("a/文", digest), ("a/文", "no")], "p string, h string").select(S.raw_id(F.col("p"), F.col("h")).alias("y"))
    assert [r.y for r in df.collect()] == [want, None]
    texts = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l", "a\n\n", "\n", "", "x", None, "a\x1fb"]
    assert one(spark, texts, S.text_lines) == [t.splitlines() if t is not None else None for t in texts]


@pytest.mark.parametrize(
    "value, text",
    [
        ({"\u20ac": 1, "\r": 2, "\ufb33": 3, "1": 4, "\U0001f600": 5, "\x80": 6, "ö": 7}, '{"\\r":2,"1":4,"\x80":6,"ö":7,"€":1,"😀":5,"\ufb33":3}'),
        ([1e21, 1e20, 1e-6, 1e-7, 0.1, -0.0, 123.0, 333333333.33333329, 4.5, 2e-3, 1.5e300], "[1e+21,100000000000000000000,0.000001,1e-7,0.1,0,123,333333333.3333333,4.5,0.002,1.5e+300]"),
        ({"a": None, "b": [True, False, {}, []]}, '{"a":null,"b":[true,false,{},[]]}'),
        ("\"\\\b\f\n\r\t\x01é", '"\\"\\\\\\b\\f\\n\\r\\t\\u0001é"'),
    ],
)
def test_canonical(value, text):
    assert canonical(value) == text


def test_canonical_refuses_and_round_trips():
    for bad in (2**53, float("nan"), float("inf"), "\ud800", {1: 2}, object()):
        with pytest.raises((ValueError, AttributeError)):
            canonical(bad)
    rnd = random.Random(0)
    for _ in range(500):
        x = rnd.uniform(-1, 1) * 10 ** rnd.randrange(-30, 30)
        assert float(json.loads(canonical(x))) == x


def test_json_columns(spark):
    texts = ['{"b":1, "a":"é"}', '{"a":1,"a":2}', "NaN", "[1,", None, "[1]", '{"a":' + "[" * 101 + "]" * 101 + "}", '{"a":"' + "x" * 500 + '"}']
    assert one(spark, texts, jcs) == ['{"a":"é","b":1}', None, None, None, None, "[1]", texts[6], texts[7]]
    assert one(spark, texts, strict_json_code(400)) == ["", "DUPLICATE_KEY", "INVALID_CONSTANT", "INVALID_JSON", "UNREADABLE", "ROOT_NOT_OBJECT", "TOO_DEEPLY_NESTED", "TOO_LARGE"]
    good = hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest().upper()
    df = spark.createDataFrame([(good, texts[0]), ("0" * 64, texts[0]), (good, None), (None, texts[0])], "h string, t string").select(snapshot_matches(F.col("h"), F.col("t")).alias("y"))
    assert [r.y for r in df.collect()] == [True, False, False, False]
    assert nesting('{"a":"[[[","b":[{"\\"":1}]}') == 3 and strict_object('{"a":1}', 10) == ({"a": 1}, None)


def test_paths():
    value = {"a": [{"b": None}], "c": {}}
    for path, there in (("$", True), ("$.a", True), ("$.a[0].b", True), ("$.a[1]", False), ("$.c.x", False), ("a", False), ("$.a[x]", False), ("$a", False)):
        assert path_exists(value, path) is there


SCHEMA = {
    "type": "object",
    "required": ["id", "kind"],
    "additionalProperties": False,
    "properties": {
        "id": {"$ref": "#/$defs/id"},
        "kind": {"enum": ["a", "b", 1]},
        "n": {"type": ["integer", "null"], "minimum": 0},
        "list": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "string", "maxLength": 2}},
        "day": {"type": "string", "format": "date"},
        "free": {"additionalProperties": {"type": "boolean"}},
        "either": {"oneOf": [{"type": "string"}, {"const": True}]},
    },
    "if": {"properties": {"kind": {"const": "b"}}},
    "then": {"required": ["n"]},
    "$defs": {"id": {"type": "string", "pattern": "^X-"}},
}


def test_schema(spark):
    from factloom.functions.schema import schema_findings, violations

    good = {"id": "X-1", "kind": "a", "n": None, "list": ["a"], "day": "2024-02-29", "free": {"q": True}, "either": True}
    assert list(violations(good, SCHEMA)) == []
    for change, want in (
        ({"id": "y"}, ("$.id", "pattern")), ({"kind": True}, ("$.kind", "enum")), ({"n": True}, ("$.n", "type")), ({"n": -1}, ("$.n", "minimum")), ({"n": 2.0}, None), ({"list": []}, ("$.list", "minItems")),
        ({"list": ["a", "a"]}, ("$.list", "uniqueItems")), ({"list": ["abc"]}, ("$.list[0]", "maxLength")), ({"day": "2023-02-29"}, ("$.day", "format")), ({"free": {"q": 1}}, ("$.free.q", "type")),
        ({"either": 1}, ("$.either", "oneOf")), ({"more": 1}, ("$.more", "additionalProperties")),
    ):
        assert list(violations(good | change, SCHEMA)) == ([want] if want else [])
    assert list(violations({"id": "X-", "kind": "b"}, SCHEMA)) == [("$", "required")]
    with pytest.raises(ValueError):
        list(violations({}, {"unknownWord": 1}))
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, "{"), (3, None), (4, "[]")], "record_id int, text string")
    assert {tuple(r) for r in schema_findings(rows, SCHEMA).collect()} == {("2", "$", "json"), ("3", "$", "json"), ("4", "$", "type")}


def test_sorted_arrays_and_identifiers(spark):
    from factloom.functions.canonical import identifier, snapshot_id

    arrays = [["a", "b"], ["b", "a"], ["a", "a"], [], None]
    assert one(spark, arrays, S.is_sorted, "array<string>") == [True, False, True, True, True]
    assert one(spark, arrays, lambda c: S.is_sorted(c, unique=True), "array<string>") == [True, False, False, True, True]
    assert one(spark, ["é", None], lambda c: identifier("ID", b=c, a=F.lit(1))) == [snapshot_id("ID", {"a": 1, "b": x}) for x in ("é", None)]
