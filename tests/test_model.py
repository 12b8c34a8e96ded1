"""The model step: what is asked, once, and what is kept."""

import json

import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.operators.model import build_prompts, run_model


def counting(folder, answer):
    """A model that leaves one file for each call."""

    def model(prompt):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        return answer(prompt)

    return model


def calls(folder):
    return sorted(p.read_text() for p in folder.iterdir())


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def test_equal_questions_are_asked_once_and_reruns_ask_nothing(spark, root, asked):
    model = lw.RememberedModel(counting(str(asked), str.upper), root, "m1")
    prompts = spark.createDataFrame([(i, f"q{i % 3}" if i % 4 else None) for i in range(40)], "i int, prompt string")
    got = {r["i"]: r["raw"] for r in run_model(prompts, model).collect()}
    assert got == {i: f"Q{i % 3}" if i % 4 else None for i in range(40)}
    assert calls(asked) == ["q0", "q1", "q2"]
    assert {r["i"]: r["raw"] for r in run_model(prompts, model).collect()} == got
    assert calls(asked) == ["q0", "q1", "q2"]
    more = prompts.union(spark.createDataFrame([(90, "q9")], "i int, prompt string"))
    assert run_model(more, model).count() == 41 and calls(asked) == ["q0", "q1", "q2", "q9"]
    run_model(prompts, lw.RememberedModel(counting(str(asked), str.upper), root, "m2")).count()
    assert len(calls(asked)) == 7  # another model, other questions


def test_failed_calls_are_tried_again(spark, root, asked):
    def fails(prompt):
        raise ValueError("down")

    prompts = spark.createDataFrame([("a", ["x"]), ("b", None)], "prompt string, other array<string>")
    assert [r["raw"] for r in run_model(prompts, lw.RememberedModel(counting(str(asked), fails), root)).collect()] == [None, None]
    again = run_model(prompts, lw.RememberedModel(counting(str(asked), str.upper), root)).collect()
    assert sorted((r["prompt"], r["other"], r["raw"]) for r in again) == [("a", ["x"], "A"), ("b", None, "B")]
    assert len(calls(asked)) == 4


def test_no_questions(spark, root):
    empty = spark.createDataFrame([], "prompt string")
    assert run_model(empty, lw.RememberedModel(str.upper, root)).collect() == []
    assert run_model(spark.createDataFrame([(None,)], "prompt string"), str.upper).collect()[0]["raw"] is None


def landed(spark):
    rows = [(c, "public", t, n, "STRING", i, True) for c in ("c1", "c2", "c3") for t in ("t", "u") for i, n in enumerate(("id", "email"), 1)]
    return spark.createDataFrame(rows, "connection_id string, table_schema string, table_name string, column_name string, data_type string, ordinal_position long, is_nullable boolean")


def test_connections_with_the_same_tables_ask_the_same(spark, root, asked):
    def answer(prompt):
        f = json.loads(prompt.split("DATA:\n", 1)[1])
        return json.dumps([{"column_name": f["column_name"], "description": f"{f['table_key']} {f['column_name']}"}])

    model = lw.RememberedModel(counting(str(asked), answer), root)
    docs = lw.schema_docs(landed(spark), model)
    assert docs.count() == 12 and len(calls(asked)) == 4
    assert {r["description"] for r in docs.where("table_key = 'public.u'").collect()} == {"public.u id", "public.u email"}
    assert lw.schema_docs(landed(spark), model).count() == 12 and len(calls(asked)) == 4


def test_column_questions_do_not_name_the_connection(spark):
    prompts = build_prompts(landed(spark), "sensitivity").select(F.substring_index("prompt", "DATA:\n", -1).alias("f")).distinct()
    facts = [json.loads(r["f"]) for r in prompts.collect()]
    assert len(facts) == 4 and {tuple(f) for f in facts} == {("table_key", "ordinal_position", "column_name", "data_type")}
