"""Replacement by scopes: failed writes, two writers, empty scopes, earlier versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from litweave import ledgers_by_scope as L


def frame(spark, rows, schema="section string, claim string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scopes_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with pytest.raises(FileNotFoundError):
        L.read_ledger(spark, path, "section")
    assert L.latest_version(spark, path) == 0
    first = [("a", "1"), ("a", "2"), ("b", "3"), (None, "4")]
    assert L.replace_scopes(path, frame(spark, first), "section") == 1
    assert L.replace_scopes(path, frame(spark, [("a", "5")]), "section") == 2
    assert rows(L.read_ledger(spark, path, "section")) == [("a", "5"), ("b", "3"), (None, "4")]
    # scopes without rows become empty, null is a scope, repeated rows stay
    L.replace_scopes(path, frame(spark, [(None, "6"), (None, "6")]), "section", frame(spark, [("b",), (None,), ("new",)], "section string"))
    assert rows(L.read_ledger(spark, path, "section")) == [("a", "5"), (None, "6"), (None, "6")]
    L.replace_scopes(path, frame(spark, []), "section", frame(spark, [("a",)], "section string"))
    assert rows(L.read_ledger(spark, path, "section")) == [(None, "6"), (None, "6")]
    assert rows(L.read_ledger(spark, path, "section", 1)) == sorted(first, key=repr) and len(rows(L.read_ledger(spark, path, "section", 2))) == 3
    L.replace_scopes(path, frame(spark, [("c", "7", 0.5)], "section string, claim string, score double"), "section")
    assert rows(L.read_ledger(spark, path, "section").select("section", "claim", "score")) == [("c", "7", 0.5), (None, "6", None), (None, "6", None)]


def test_a_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    L.replace_scopes(path, frame(spark, [("a", "1")]), "section")

    def dies(self, text, *parts):
        if parts[0] == "commits":
            raise KeyboardInterrupt
        return create(self, text, *parts)

    create = L._Files.create
    monkeypatch.setattr(L._Files, "create", dies)
    with pytest.raises(KeyboardInterrupt):
        L.replace_scopes(path, frame(spark, [("a", "2")]), "section")
    monkeypatch.setattr(L._Files, "create", create)
    bad = frame(spark, [("a", "x")]).selectExpr("section", "raise_error(claim) as claim")
    with pytest.raises(Exception, match="x"):
        L.replace_scopes(path, bad, "section")
    with pytest.raises(ValueError, match="outside"):
        L.replace_scopes(path, frame(spark, [("b", "2")]), "section", frame(spark, [("a",)], "section string"))
    assert rows(L.read_ledger(spark, path, "section")) == [("a", "1")] and L.latest_version(spark, path) == 1
    assert L.replace_scopes(path, frame(spark, [("a", "3")]), "section") == 3  # the dead write's number stays taken
    assert rows(L.read_ledger(spark, path, "section")) == [("a", "3")]


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    L.replace_scopes(path, frame(spark, [(s, "0") for s in "abcd"]), "section")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda s: L.replace_scopes(path, frame(spark, [(s, "1"), (s, "2")]), "section", since=1), "abcd"))
    assert sorted(versions) == [2, 3, 4, 5]
    assert rows(L.read_ledger(spark, path, "section")) == [(s, c) for s in "abcd" for c in "12"]
    assert L.replace_scopes(path, frame(spark, [("a", "3")]), "section", since=5) == 6
    with pytest.raises(L.Conflict):
        L.replace_scopes(path, frame(spark, [("a", "4"), ("e", "4")]), "section", since=5)
    assert rows(L.read_ledger(spark, path, "section").where("section in ('a', 'e')")) == [("a", "3")]
