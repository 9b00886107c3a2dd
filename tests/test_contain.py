import json

from pyspark.sql import functions as F

from lexilake.functions import contain as J

DOCUMENTS = [
    '{"a": 1, "b": {"c": [1, 2, {"d": null}], "e": "x"}}', '{"b": {"e": "x", "c": [{"d": null, "f": 0}, 2]}, "a": 1.0}', "[1, 2, [1, 3]]", '["foo", "bar"]',
    '"foo"', "1", "1.5", "null", "true", "{}", "[]", '{"a": {"b": 1}}', '[{"a": 1}, {"b": 2}]', '{"a": null}', '{"a b.c": "1"}', '{"a": "1"}', None,
]
WANTED = [
    {}, [], {"a": 1}, {"b": {"c": [2]}}, {"b": {"c": [{"d": None}]}}, {"b": 1}, [1], [3], [[1]], [[3, 1], 1], [1, 1, 2], "foo", ["bar", "foo"], 1, 1.5, None, True,
    {"a": None}, [{"a": 1}], [{"a": 1, "b": 2}], {"a b.c": "1"}, {"a": "1"}, "1",
]


def holds(own, wanted, top=True):
    if isinstance(wanted, dict):
        return isinstance(own, dict) and all(k in own and holds(own[k], v, False) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(own, list) and all(any(holds(x, v, False) for x in own) for v in wanted)
    if top and isinstance(own, list):
        return any(holds(x, wanted, False) for x in own)
    return not isinstance(own, dict | list) and isinstance(own, bool) == isinstance(wanted, bool) and isinstance(own, str) == isinstance(wanted, str) and own == wanted


def test_containment(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(DOCUMENTS)], "i int, x string").select("i", F.parse_json("x").alias("v"))
    got = df.select("i", *(J.json_contains(F.col("v"), w).alias(f"w{j}") for j, w in enumerate(WANTED))).orderBy("i").collect()
    for row, text in zip(got, DOCUMENTS, strict=True):
        assert list(row)[1:] == [text is not None and holds(json.loads(text), w) for w in WANTED], text
