import json

from pyspark.sql import functions as F

from tessera.operators import structured as J


def flattened(x):
    if isinstance(x, list):
        for y in x:
            yield from flattened(y)
    elif isinstance(x, dict):
        yield x
        for y in x.values():
            yield from flattened(y)


DEEP = {"@type": "E"}
for _ in range(120):
    DEEP = {"k": [[DEEP], None, 3]}
VALUES = [{"@type": ["A", 5, "B"], "x": {"@type": "C", "y": [[{"@type": "D"}], [1, {"z": {}}]]}, "n": None}, [{"@type": "Q"}, [[], [{"a.b": {"c d": {}}}]]], [], 7, "t", DEEP]


def test_walk_equals_plain_recursion(spark):
    df = spark.createDataFrame([(k, json.dumps(v), "x") for k, v in enumerate(VALUES)] + [(90, "{bad", "x"), (91, None, "x"), (92, '{"a":1} {"b":2}', "x"), (93, '{"a":1}, 2', "x")], "id long, j string, path string")
    out = J.flat_objects(df.select("id", "path", J.whole_json(F.col("j")).alias("v")).withColumnRenamed("path", "w"))
    got = {}
    for r in out.select("id", F.to_json("node").alias("j")).collect():
        got.setdefault(r.id, []).append(json.dumps(json.loads(r.j), sort_keys=True))
    for k, v in enumerate(VALUES):
        assert sorted(got.get(k, [])) == sorted(json.dumps(x, sort_keys=True) for x in flattened(v))
    assert set(got) == {0, 1, 5}


def test_types_and_countries(spark):
    cases = [('{"@type":["A",5,"B"]}', ["A", "B"], ""), ('{"@type":"C","address":{"addressCountry":{"name":" us "}}}', ["C"], "us"), ('{"address":{"addressCountry":"DE"}}', [], "DE"), ('{"@type":3,"address":"x"}', [], "")]
    df = spark.createDataFrame([(c[0],) for c in cases], "j string").select("j", F.parse_json("j").alias("node"))
    for r in df.select("j", J.types_of().alias("t"), J.country_of().alias("c")).collect():
        assert (r.t, r.c) == next((t, c) for j, t, c in cases if j == r.j)


def test_fenced_answers(spark):
    texts = ['```json\n{"a": 1}\n```', 'It is {"a": {"b": 2}} I think', "```\n[1, 2]\n```", "no json", "", None, '{"a": 1} and {"b": 2}']
    want = ['{"a":1}', '{"a":{"b":2}}', "[1,2]", None, None, None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.j for r in df.select("k", F.to_json(J.fenced_json(F.col("t"))).alias("j")).collect()}
    assert [got[k] for k in range(len(texts))] == want


SCHEMA = {"type": "object", "properties": {"answer": {"enum": ["yes", "no"]}, "score": {"type": "number"}, "parts": {"type": "array", "items": {"properties": {"n": {"type": "integer"}}}}}}


def test_strict_schema():
    made = J.strict({**SCHEMA, "required": ["answer"], "additionalProperties": True})
    assert made["required"] == ["answer", "score", "parts"] and made["additionalProperties"] is False
    assert made["properties"]["answer"] == {"enum": ["yes", "no"], "type": "string"}
    assert made["properties"]["parts"]["items"] == {"properties": {"n": {"type": "integer"}}, "type": "object", "required": ["n"], "additionalProperties": False}
    assert "required" not in SCHEMA


def test_conforms(spark):
    good = ['{"answer":"yes","score":0.5,"parts":[]}', '{"parts":[{"n":1},{"n":2}],"score":3,"answer":"no"}']
    bad = ['{"answer":"maybe","score":0.5,"parts":[]}', '{"answer":"yes","score":"1","parts":[]}', '{"answer":"yes","score":1}', '{"answer":"yes","score":1,"parts":[],"more":1}', '{"answer":"yes","score":1,"parts":[{"n":"x"}]}', '{"answer":"yes","score":1,"parts":[7]}', "[]", "null", '{"answer":"yes","score":1,"parts":null}']
    df = spark.createDataFrame([(x,) for x in good + bad], "j string").select("j", F.parse_json("j").alias("v"))
    got = {r.j: r.ok for r in df.select("j", J.conforms("v", SCHEMA).alias("ok")).collect()}
    assert [got[x] for x in good] == [True, True] and not any(got[x] for x in bad)
