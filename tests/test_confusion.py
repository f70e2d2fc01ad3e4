"""Confusion counts over given labels, all labels and seen pairs; places of a seeded order."""

from __future__ import annotations

import pytest

from skyloom.operators import evaluate as ev
from skyloom.operators import reshape as rh

ROWS = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "a"), ("c", "c"), (None, "a"), ("b", None), (None, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "y string, p string")


def found(out):
    return {(r["actual"], r["predicted"]): r["n"] for r in out.collect()}


def test_given_labels_leave_others_out(df):
    got = found(ev.confusion_matrix(df, "y", "p", labels=["a", "b", "z", "a"]))
    assert len(got) == 9 and sum(got.values()) == 6
    assert (got["a", "a"], got["a", "b"], got["b", "a"], got["z", "z"]) == (3, 2, 1, 0)
    assert found(ev.confusion_matrix(df, "y", "p", errors_only=True, labels=["a", "b"])) == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 1, ("b", "b"): 0}


def test_seen_pairs_keep_rows_without_a_label(df):
    got = found(ev.confusion_matrix(df, "y", "p", all_pairs=False))
    assert sum(got.values()) == len(ROWS) and got[None, "a"] == got["b", None] == got[None, None] == 1
    wrong = found(ev.confusion_matrix(df, "y", "p", errors_only=True, all_pairs=False))
    assert wrong == {k: n for k, n in got.items() if k[0] != k[1]}


def test_all_labels_and_empty_frames(spark, df):
    assert len(found(ev.confusion_matrix(df, "y", "p"))) == 9
    empty = df.where("y = 'q'")
    assert found(ev.confusion_matrix(empty, "y", "p")) == {} == found(ev.confusion_matrix(empty, "y", "p", all_pairs=False))
    assert found(ev.confusion_matrix(empty, "y", "p", labels=["a"])) == {("a", "a"): 0}


def test_places_follow_the_seeded_order(spark):
    ids = spark.range(500).repartition(7)
    order = [r["id"] for r in rh.seeded_shuffle(ids, ["id"], 3).collect()]
    placed = rh.seeded_positions(ids, ["id"], 3, "at").orderBy("at").collect()
    assert [r["id"] for r in placed] == order and [r["at"] for r in placed] == list(range(1, 501))
