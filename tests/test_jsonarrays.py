"""Array elements across block borders, against the json module."""

import json
import random

from strandline.sources import jsonarrays

RNG = random.Random(9)


def value(depth=0):
    kind = RNG.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return RNG.randint(-999, 999)
    if kind == 1:
        return "".join(RNG.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "\n", "x y"]) for _ in range(RNG.randrange(9)))
    if kind == 2:
        return RNG.choice([None, True, 1.5, ""])
    if kind == 3:
        return {}
    if kind == 4:
        return [value(depth + 1) for _ in range(RNG.randrange(4))]
    return {f"k{i},": value(depth + 1) for i in range(RNG.randrange(4))}


def test_elements_cross_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "47b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = {"a": [value() for _ in range(120)], "b": [value() for _ in range(40)], "none": [], "one": [{"a": [1, 2]}], "word": ["x,y"]}
        for name, v in files.items():
            text = json.dumps(v, indent=1 if name == "b" else None, ensure_ascii=name == "b")
            (tmp_path / f"{name}.json").write_text(f" {text}\n")
        (tmp_path / "object.json").write_text('{"a": [1, 2], "b": 3}')
        (tmp_path / "empty.json").write_text("")
        got = {}
        for r in jsonarrays.array_elements(spark, [str(tmp_path)]).orderBy("path", "block", "at").collect():
            got.setdefault(r["path"].rsplit("/", 1)[1][:-5], []).append(json.loads(r["doc"]))
        assert got == {k: v for k, v in files.items() if v}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_are_not_moved(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": i, "b": [i, "x,y"]} for i in range(300)]))
    d = jsonarrays.array_elements(spark, [str(tmp_path)])
    assert [json.loads(r["doc"])["a"] for r in d.orderBy("block", "at").collect()] == list(range(300))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan                                  # only stored parts, of which the edges are joined
