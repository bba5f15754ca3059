"""The sink of pages: only whole sites are published, whatever becomes of tasks."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from codestrata.sources import pages as P

ROOT = Path(__file__).resolve().parent.parent


def files(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file()}


def rows(spark, names, parts=3):
    return spark.createDataFrame([(n, f"<p>{n}é</p>", 7) for n in names], "rel_path string, html string, extra int").repartition(parts)


def test_pages_replace_the_old_site(spark, tmp_path):
    target = tmp_path / "deep/site"
    first, second = [f"a/b{i}.html" for i in range(20)] + ["index.html"], [f"a/b{i}.html" for i in range(5)] + ["c/d/e.html"]
    for names in (first, second):
        P.write_pages(rows(spark, names), str(target))
        assert files(target) == {n: f"<p>{n}é</p>" for n in names}
    assert [p.name for p in target.parent.iterdir()] == ["site"]
    P.write_pages(rows(spark, ["more.html"]), f"file://{target}", "append")
    assert set(files(target)) == {*second, "more.html"}
    P.write_pages(rows(spark, first).limit(0), str(target))
    assert files(target) == {}


@pytest.mark.parametrize("names", [["x.html", "../out.html"], ["/abs.html"], ["a//b.html"], [None], ["same.html", "same.html"], ["same.html"] * 40])
def test_what_is_no_page_changes_nothing(spark, tmp_path, names):
    target = tmp_path / "site"
    P.write_pages(rows(spark, ["index.html"]), str(target))
    with pytest.raises(Exception):  # noqa: B017
        P.write_pages(rows(spark, [*names, *(f"p{i}" for i in range(20))]), str(target))
    assert files(target) == {"index.html": "<p>index.htmlé</p>"}
    assert [p.name for p in tmp_path.iterdir()] == ["site"]


def test_a_page_that_is_there_already_cannot_be_added(spark, tmp_path):
    P.write_pages(rows(spark, ["index.html"]), str(tmp_path / "site"))
    with pytest.raises(Exception, match="index.html"):
        P.write_pages(rows(spark, ["index.html"]), str(tmp_path / "site"), "append")


def test_a_failing_task_leaves_the_old_site(spark, tmp_path):
    target = tmp_path / "site"
    P.write_pages(rows(spark, ["index.html"]), str(target))
    bad = rows(spark, [f"p{i}.html" for i in range(50)]).withColumn("html", F.when(F.col("rel_path") == "p31.html", F.raise_error(F.lit("no"))).otherwise(F.col("html")))
    with pytest.raises(Exception):  # noqa: B017
        P.write_pages(bad, str(target))
    assert files(target) == {"index.html": "<p>index.htmlé</p>"} and [p.name for p in tmp_path.iterdir()] == ["site"]


RETRIED = """
import os, sys
from pyspark.sql import SparkSession
from codestrata.sources.pages import write_pages
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
folder = sys.argv[1]

def fail_once(batches):
    from pyspark import TaskContext
    for batch in batches:
        half = batch.num_rows // 2
        yield batch.slice(0, half)
        mark = f"{folder}/failed-{TaskContext.get().partitionId()}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost after half of the pages")
        yield batch.slice(half)

pages = spark.range(0, 4000, 1, 4).selectExpr("concat('p/', id, '.html') AS rel_path", "repeat(concat('x', id), 20) AS html")
write_pages(pages.mapInArrow(fail_once, pages.schema), folder + "/site")
assert len([f for f in os.listdir(folder) if f.startswith("failed-")]) == 4
"""


def test_a_task_that_fails_once_leaves_no_page_twice_or_half(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True, env=env, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert files(tmp_path / "site") == {f"p/{i}.html": f"x{i}" * 20 for i in range(4000)}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_publishing_without_renaming_of_folders(monkeypatch, tmp_path):
    store = fs.LocalFileSystem()
    monkeypatch.setattr(P, "renames_folders", lambda store: False)
    for name, text in (("old/stale.html", "1"), ("index.html", "1"), (".new/site/index.html", "2"), (".new/site/a/b.html", "2")):
        path = tmp_path / ("site/" + name if name[0] != "." else name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    P.publish(store, str(tmp_path / ".new/site"), str(tmp_path / "site"), str(tmp_path / ".new"))
    assert files(tmp_path / "site") == {"index.html": "2", "a/b.html": "2"}


def test_an_attempt_that_the_driver_cannot_see(tmp_path):
    with pytest.raises(FileNotFoundError, match="share"):
        P.gather(fs.LocalFileSystem(), str(tmp_path / "gone"), str(tmp_path), 1)
