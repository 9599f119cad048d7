import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import documents, plain_yaml

PLAIN = ["1", "26.2", "x y", "it's", "a#b", "-1", "http://a/b?c", "true", "", "''", "'q ''s'", '"d \\"x\\" \\\\ y\\n\\tz"', "'# no'", "v # said", "null", "~", "'a: b'", "2026-01-01", "é 中"]
FILES = {
    "tags: [a, b]": "no plain value", "a: {b: 1}": "no plain value", "a: |\n  text": "no plain value", "a: >\n  text": "no plain value", "a: &x 1": "no plain value", "a: *x": "no plain value",
    "list:\n- a: 1\n   b: 2": "indentation of the key", "list:\n- a: 1\n - b: 2": "indentation of the item", "list:\n  a: 1": "nested map", "list:\n- a:\n    b: 1": "nested value",
    "list:\n- a: one\n  two": "no key", "list:\n-\n  a: 1": "bare dash", "a: 1\n- b: 2": "item under a scalar", "list:\n- a: 'open": "no plain value", "list:\n- x\n  a: 1": "key under a scalar",
    "list:\n\t- a: 1": "tab in the indentation", "list:\n- a: b: c": "no plain value", "- a: 1\nlist:\n- b: 2": "list and map at the root",
}


def texts(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_plain_files_give_what_the_library_gives(spark, tmp_path):
    rng = random.Random(9)
    for i in range(60):
        pad, dash = " " * rng.choice([0, 2, 4]), "-" + " " * rng.choice([1, 3])
        out = rng.choice([[], ["# comment", "", "name: 'x'"], ["---", "other:", "- z: 1"]]) if i % 3 else []
        if i % 3:
            out.append("evidence:" + rng.choice(["", " # list"]))
        else:
            pad = ""
        for _ in range(rng.randrange(5)):
            keys = [rng.choice(["id", "name", "n_1", "a.b"]) for _ in range(rng.randrange(1, 5))]
            for k, key in enumerate(keys):
                value = rng.choice(PLAIN)
                out.append(f"{pad}{dash if not k else ' ' * len(dash)}{key}:{' ' if value else ''}{value}")
            if rng.random() < 0.3:
                out.append(rng.choice(["", "  # between", f"{pad}{dash}3"]))
        if i % 5 == 0 and i % 3:
            out += ["tail: 1"]
        (tmp_path / f"{i}.yml").write_text("\n".join(out), encoding="utf-8", newline="\r\n" if i % 7 == 0 else "\n")
    schema = "id string, name string, n_1 string, `a.b` string"
    ours, theirs = (sorted(map(str, read(spark, str(tmp_path), "evidence", schema).collect())) for read in (plain_yaml.read_plain_list, documents.read_yaml_list))
    assert ours == theirs and len(ours) > 60


@pytest.mark.parametrize("with_rows", [False, True])
def test_what_is_beyond_the_subset_is_refused_with_its_file(spark, with_rows):
    more = "\nlist:\n- a: 1" if with_rows else ""
    rows = [(f"{i}", t + (more if "list" not in t and not t.startswith("a: 1") else "")) for i, t in enumerate(FILES)] + [("fine", "list:\n- a: 1\n- a: 2")]
    got = {r["path"]: r["refused"] for r in plain_yaml.refusals(texts(spark, rows)).orderBy(F.desc("n")).collect()}
    assert got == {f"{i}": why for i, why in enumerate(FILES.values())}
    assert {(r["path"], r["data"]["a"]) for r in plain_yaml.list_items(texts(spark, rows), "list").collect()} == {("fine", "1"), ("fine", "2")}


def test_front_matter_scalars(spark):
    rows = [("a", "product_id: p\nupdate_version: 26.2\nnote: 'x -----'\nlist:\n- z: 1"), ("b", "x: [1]"), ("c", ""), ("d", None)]
    got = {r["path"]: r["data"] for r in plain_yaml.scalars(texts(spark, rows)).collect()}
    assert got == {"a": {"product_id": "p", "update_version": "26.2", "note": "x -----"}}
    assert json.dumps(got["a"])


def test_lines_are_sorted_once(spark):
    """One order for all windows: a task holds its files' lines in one sort, not in one a window."""
    texts = spark.createDataFrame([("a", "x:\n  - k: 1\n    j: 2\ny: 3\n- k: 4")], "path string, text string")
    plan = plain_yaml.lines(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") == 1
    got = plain_yaml.lines(texts).orderBy("n").select("root", "item", "key", "refused").collect()
    assert [tuple(r) for r in got] == [("x", 0, "x", None), ("x", 1, "k", None), ("x", 1, "j", None), ("y", 0, "y", None), ("y", 1, "k", "item under a scalar")]
