"""The commit log: one winner of each place, whole sources, promotions."""

import threading

import pytest

from attesta.sources import commits, files


def race(*jobs):
    """Run jobs at once; their results or errors."""
    out, gate = [None] * len(jobs), threading.Barrier(len(jobs))

    def run(i, job):
        gate.wait()
        try:
            out[i] = job()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=run, args=(i, j)) for i, j in enumerate(jobs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def tables(spark, k):
    one = spark.createDataFrame([(k, "v")], "k int, version string")
    return {n: one for n in files.TABLES}


@pytest.fixture
def none_failed(spark):
    return spark.createDataFrame([], "version string, failed string")


def test_a_file_is_put_once(spark, tmp_path):
    got = race(*[lambda i=i: commits.put_absent(spark, f"file:{tmp_path}/log/0.json", f"{i}") for i in range(12)])
    assert sorted(got) == [False] * 11 + [True] and (tmp_path / "log/0.json").read_text() == str(got.index(True))
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["0.json"]


def test_a_file_is_put_once_by_renaming(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "_local", lambda path: None)
    assert commits.put_absent(spark, f"file:{tmp_path}/0.json", "one") and not commits.put_absent(spark, f"file:{tmp_path}/0.json", "two")
    assert (tmp_path / "0.json").read_text() == "one" and not [p for p in tmp_path.iterdir() if "json-" in p.name and not p.name.endswith(".crc")]


def test_two_writers_of_a_source_leave_one_loser(spark, tmp_path):
    path = str(tmp_path / "c")
    assert commits.newest(spark, path) == -1 and commits.history(spark, path).count() == 0
    files.write_source(tables(spark, 0), path, "v", "s")
    base = commits.newest(spark, path)
    got = race(*[lambda k=k: (k, files.write_source(tables(spark, k), path, "v", "s", since=base)) for k in (1, 2)])
    lost = [g for g in got if isinstance(g, commits.Conflict)]
    won = [g for g in got if isinstance(g, tuple)]
    assert len(lost) == len(won) == 1
    assert {r.k for r in files.read_source_tables(spark, path, "v", "chunks").collect()} == {won[0][0]}
    assert [r.number for r in commits.history(spark, path).orderBy("number").collect()] == [0, 1]


def test_writers_of_other_sources_all_get_through(spark, tmp_path):
    path = str(tmp_path / "c")
    got = race(*[lambda k=k: files.write_source(tables(spark, k), path, "v", f"s{k}", since=-1) for k in range(4)])
    assert all(isinstance(g, str) for g in got)
    assert sorted(r.number for r in commits.history(spark, path).collect()) == [0, 1, 2, 3]
    assert {r.k for r in files.read_source_tables(spark, path, "v", "edges").collect()} == {0, 1, 2, 3}


def test_a_folder_without_a_commit_is_not_read(spark, tmp_path):
    path = str(tmp_path / "c")
    files.write_source(tables(spark, 1), path, "v", "s")
    broken = {**tables(spark, 2), "document_versions": spark.range(1).selectExpr("assert_true(id < 0) AS k")}
    with pytest.raises(Exception):
        files.write_source(broken, path, "v", "s")
    assert {r.k for r in files.read_source_tables(spark, path, "v", "chunks").collect()} == {1}


def test_promotions(spark, tmp_path, none_failed):
    path = str(tmp_path / "c")
    for v in ("a", "b", "c"):
        files.write_source(tables(spark, 1), path, v, "s")
    status = lambda: {r.version: r.status for r in commits.statuses(spark, path).collect()}
    assert set(status().values()) == {"staged"}
    with pytest.raises(ValueError, match="fails recall"):
        commits.promote(spark, path, "a", spark.createDataFrame([("a", "recall")], "version string, failed string"), 2)
    commits.promote(spark, path, "a", none_failed, 2)
    got = race(*[lambda v=v: commits.promote(spark, path, v, none_failed, 3) for v in ("b", "c")])
    assert sum(isinstance(g, commits.Conflict) for g in got) == 1 and got.count(4) == 1
    live, left = ("b", "c") if got[0] == 4 else ("c", "b")
    assert status() == {"a": "retired", live: "live", left: "staged"}
    for v in ("a", live, "unknown"):
        with pytest.raises(ValueError, match="not_staged"):
            commits.promote(spark, path, v, none_failed, 4)


def test_checks_hold_for_what_was_checked(spark, tmp_path, none_failed):
    path = str(tmp_path / "c")
    files.write_source(tables(spark, 1), path, "v", "s")
    checked = commits.newest(spark, path)
    files.write_source(tables(spark, 2), path, "v", "t")
    with pytest.raises(commits.Conflict):
        commits.promote(spark, path, "v", none_failed, checked)
    files.write_source(tables(spark, 1), path, "w", "s")
    assert commits.promote(spark, path, "v", none_failed, commits.newest(spark, path) - 1) == 3  # another version's source doesn't matter
    with pytest.raises(commits.Conflict):  # nor does a promoted version take sources that were begun before
        files.write_source(tables(spark, 3), path, "v", "u", since=checked)
