import os

import pytest

import __spark_entry__ as entry

HERE = os.path.isdir("/root/testdata/sf0.001")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "lodestone")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "lodestone.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()


@pytest.mark.skipif(not HERE, reason="no sample tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["filePath", "content", "score"]


@pytest.mark.skipif(not HERE, reason="no sample tables here")
@pytest.mark.parametrize("name", ["p2_found", "change_classify", "enclosing_symbol", "tag_graph_edges", "keyword_search", "semantic_topk", "task_detect", "last_event_wins", "graph_degrees", "debounce_batches"])
def test_against_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = entry.queries()[name](spark, folder)
    cols = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    q = ", ".join(f'"{c}"' for c in cols)
    theirs = sorted((tuple(r) for r in con.execute(f"SELECT {q} FROM ({entry.oracle_sql()[name]})").fetchall()), key=repr)
    assert mine == theirs


def test_shipping_writes_nothing_into_the_package(tmp_path):
    import io
    import shutil
    import subprocess
    import sys
    import zipfile

    home = os.path.join(os.path.dirname(entry.__file__), "lodestone")
    copy = tmp_path / "lodestone"
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns("__pycache__"))
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    code = "import lodestone.session as s, sys, os; sys.stdout.buffer.write(s.package_archive(os.path.dirname(s.__file__)))"
    made = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, check=True).stdout
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    names = zipfile.ZipFile(io.BytesIO(made)).namelist()
    assert "lodestone/session.py" in names and "lodestone/operators/store.py" in names and not [n for n in names if not n.endswith(".py")]


def test_session_defaults_leave_a_running_session_alone(spark):
    from lodestone.session import build_session

    same = build_session("other", shuffle_partitions=None)
    assert same.sparkContext.applicationId == spark.sparkContext.applicationId and same.conf.get("spark.sql.session.timeZone") == "UTC" and same.sparkContext.appName != "other"
