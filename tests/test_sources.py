"""Landed JSON pages (S1-S3) and the streaming reader."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidecast.sources import landed as L
from tidecast.streaming import landed_stream as LS


def _write(root, entity, repo, page, payload):
    d = os.path.join(root, entity, *repo.split("/"))
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"page-{page:04d}.json"), "w") as f:
        json.dump(payload, f, indent=1)


@pytest.fixture()
def landing(scratch):
    root = os.path.join(scratch, "landing")
    _write(root, "issues", "own/rep", 1, [
        {"number": 1, "created_at": "2024-03-05T10:11:12Z", "closed_at": None, "state": "open",
         "user": {"login": "ann"}},
        {"number": 2, "created_at": "2024-03-06T10:11:12Z", "closed_at": "2024-04-01T00:00:00Z",
         "state": "closed", "user": {"login": "bob"}}])
    _write(root, "pulls", "own/rep", 1, [{"number": 5, "created_at": "2024-01-02T00:00:00Z"},
                                         {"number": 6, "created_at": "not a date"}])
    _write(root, "commits", "own/rep", 1, [{"sha": "abc", "commit": {"author": {"date": "2024-02-02T01:00:00Z"}}}])
    _write(root, "branches", "own/rep", 1, [{"name": "main", "commit": {"sha": "s1"}},
                                            {"name": "dev", "commit": {"sha": "s2"}}])
    _write(root, "branches", "own/rep", 2, [{"name": "old", "commit": {"sha": "s3"}}])
    _write(root, "contributors", "own/rep", 1, [{"login": "ann", "contributions": 9}, {"contributions": 3},
                                                {"login": "cy"}])
    _write(root, "releases", "own/rep", 1, [{"name": "v1", "published_at": "2024-01-01T00:00:00Z"},
                                            {"published_at": "2024-02-01T00:00:00Z"},
                                            {"name": "draft", "published_at": None},
                                            {"name": "odd", "published_at": "2024-02-01 00:00:00"}])
    d = os.path.join(root, "repository", "own", "rep")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "repo.json"), "w") as f:
        json.dump({"full_name": "own/rep", "stargazers_count": 12}, f)
    return root


def test_issues(spark, landing):
    rows = {r.issue_number: r for r in L.read_entity(spark, landing, "issues").collect()}
    assert rows[1].repo == "own/rep" and rows[1].created_at == dt.date(2024, 3, 5) and rows[1].closed_at is None
    assert rows[2].closed_at == dt.date(2024, 4, 1) and rows[2].author == "bob"


def test_pulls_and_commits(spark, landing):
    p = L.read_entity(spark, landing, "pulls")
    assert p.where(F.col("created_at").isNotNull()).count() == 1 and p.count() == 2
    c = L.read_entity(spark, landing, "commits").first()
    assert c.sha == "abc" and c.date is not None


def test_list_positions_and_defaults(spark, landing):
    b = L.read_entity(spark, landing, "branches").orderBy("seq").collect()
    assert [r.name for r in b] == ["main", "dev", "old"]
    c = L.read_entity(spark, landing, "contributors").orderBy("seq").collect()
    assert [(r.name, r.contributions) for r in c] == [("ann", 9), ("unknown", 3), ("cy", 0)]


def test_releases_strict(spark, landing):
    r = L.read_entity(spark, landing, "releases").orderBy("published_at").collect()
    # missing/null published_at dropped; the non-strict text does not parse
    assert [(x.name, x.published_at is not None) for x in r] == [("odd", False), ("v1", True), ("unknown", True)] \
        or sorted((x.name, x.published_at is not None) for x in r) == [("odd", False), ("unknown", True), ("v1", True)]


def test_repository_defaults(spark, landing):
    r = L.read_repository(spark, landing).first()
    assert (r.repo, r.stars, r.forks) == ("own/rep", 12, 0)


def test_concat_pages(spark, landing):
    a = L.read_entity(spark, landing, "pulls")
    b = L.read_entity(spark, landing, "commits")
    assert L.concat_pages(a, b).count() == 3


def test_stream_monthly_counts(spark, landing, scratch):
    ck = os.path.join(scratch, "ck")
    got = {}

    def sink(df, _bid):
        for r in df.collect():
            got[(r.repo, r.ds)] = r.y

    q = LS.start_monthly_counts(spark, landing, "issues", ck, sink=sink, trigger_once=True)
    q.awaitTermination(120)
    assert got == {("own/rep", dt.date(2024, 3, 1)): 2.0}
    _write(landing, "issues", "own/rep", 2, [{"number": 3, "created_at": "2024-03-09T00:00:00Z",
                                              "closed_at": None, "state": "open", "user": {"login": "c"}}])
    q = LS.start_monthly_counts(spark, landing, "issues", ck, sink=sink, trigger_once=True)
    q.awaitTermination(120)
    assert got[("own/rep", dt.date(2024, 3, 1))] == 3.0
