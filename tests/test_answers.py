"""Kept answers: nothing is asked twice, whatever tasks do, and the budget counts calls."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from codestrata.operators import answers

ROOT = Path(__file__).resolve().parent.parent
PROMPT = "tier int, node_id string, chunk long, prompt string"


def model_that_counts(folder):
    def model(prompt):
        with open(f"{folder}/{abs(hash(prompt))}-{os.getpid()}-{os.urandom(4).hex()}", "w") as f:
            f.write(prompt)
        if "bad" in prompt:
            raise TimeoutError
        return f"answer to {prompt}"

    return model


def asked_prompts(folder):
    return sorted(p.read_text() for p in Path(folder).iterdir())


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def told(df):
    return sorted((r.node_id, r.chunk, r.text, r.called) for r in df.collect())


def test_answers_are_kept_for_later_runs(spark, tmp_path, calls):
    folder, model = str(tmp_path / "answers"), model_that_counts(calls)
    prompts = spark.createDataFrame([(4, "a", 0, "p"), (4, "a", 1, "q"), (4, "b", 0, "p"), (4, "c", 0, "bad")], PROMPT)
    first = answers.ask(prompts, model, "m", 10, 99, folder)
    assert told(first) == [("a", 0, "answer to p", True), ("a", 1, "answer to q", True), ("b", 0, "answer to p", False), ("c", 0, None, True)]
    assert asked_prompts(calls) == ["bad", "p", "q"]
    more = prompts.unionByName(spark.createDataFrame([(4, "d", 0, "r"), (4, "e", 0, "s")], PROMPT))
    again = told(answers.ask(more, model, "m", 2, 99, folder))  # two calls: what failed is asked again, and one more
    assert [r[0] for r in again if r[3]] == ["c", "d"] and ("b", 0, "answer to p", False) in again and not [r for r in again if r[0] == "e"]
    assert asked_prompts(calls) == ["bad", "bad", "p", "q", "r"]
    assert [r[3] for r in told(answers.ask(prompts.where("node_id = 'a'"), model, "other", 10, 99, folder))] == [True, True]
    assert told(answers.ask(prompts.limit(0), model, "m", 5, 99, folder)) == []


def test_without_a_folder_nothing_is_kept(spark, calls):
    prompts = spark.createDataFrame([(4, "a", 0, "one two three")], PROMPT)
    for n in (1, 2):
        assert told(answers.ask(prompts, model_that_counts(calls), "m", 5, 3)) == [("a", 0, "answer to one", True)]
        assert len(asked_prompts(calls)) == n


RETRIED = """
import os, sys
from pyspark.sql import SparkSession
from codestrata.operators import answers
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
folder = sys.argv[1]
spark.sparkContext.setCheckpointDir(folder + "/checkpoints")

def model(prompt):
    mark = f"{folder}/failed"
    if len(os.listdir(folder + "/calls")) == 20 and not os.path.exists(mark):
        open(mark, "w").close()
        os._exit(1)  # the worker is lost after half of the answers
    with open(f"{folder}/calls/{prompt}-{os.urandom(4).hex()}", "w"):
        pass
    return "a " + prompt

prompts = spark.range(40).selectExpr("4 AS tier", "concat('n', id) AS node_id", "0L AS chunk", "concat('p', id) AS prompt")
got = answers.ask(prompts, model, "m", 100, 99, folder + "/answers", partitions=1).collect()
assert os.path.exists(folder + "/failed")
assert sorted(r.text for r in got) == sorted(f"a p{i}" for i in range(40)) and all(r.called for r in got)
"""


def test_a_lost_task_never_asks_twice(tmp_path, calls):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True, env=env, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    asked = [p.name.split("-")[0] for p in calls.iterdir()]
    assert len(asked) == len(set(asked)) == 40
