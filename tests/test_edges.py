"""Queries give what their SQL gives in DuckDB on rows that only larger tables hold."""

import math

import duckdb
import pytest

from marlstone.operators import encode
from marlstone.plans import agents, corpus, inputs, registry, retrieval, series, small  # noqa: F401


def plain(v):
    return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.fixture
def same(spark, tmp_path):
    """Both engines' rows of a query over tables given as DuckDB's VALUES: asserted alike, returned in order."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        cur = con.execute(registry.SQL[name])
        cols = [d[0] for d in cur.description]
        want = sorted(([plain(v) for v in r] for r in cur.fetchall()), key=str)
        got = sorted(([plain(r[c]) for c in cols] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
        assert got == want
        return got

    return run


def test_faithfulness_needs_every_judge(same):
    values = "(5, 'a', 2.0), (6, 'a', 3.0), (7, 'b', 1.0), (8, 'b', 0.0), (9, 'c', -1.0), (13, 'd', NULL), (14, 'd', 1.0), (15, 'e', NULL)"
    got = same("faithfulness", events=f"SELECT * FROM (VALUES {values}) t(event_id, event_type, value)".replace("(5, ", "(5::BIGINT, ").replace("2.0", "2.0::DOUBLE"))
    assert [r[1] is None for r in got] == [False, True, True, False, True]


def test_replay_clock_and_order(same):
    events = """SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, event_type FROM (VALUES
        (0, '2024-01-01 00:00:00.6', 1, 'a'), (1, '2024-01-02 00:00:00.4', 1, 'a'), (2, '2024-01-02 00:00:00.5', 1, 'a'), (3, '2024-01-02 00:00:00.7', 1, 'a'),
        (9, '2024-01-01 00:00:00.1', 2, 'a'), (4, '2024-01-01 00:00:00.2', 2, 'a'),
        (5, NULL, 3, 'a'), (6, '2024-01-01', 3, 'a'), (7, NULL, 4, 'a'), (8, NULL, 4, 'a'),
        (10, '2024-01-02', NULL, 'a'), (11, '2024-01-01', NULL, 'a'), (12, NULL, NULL, NULL), (13, '2024-01-01', 5, NULL), (14, '2024-01-01', 5, '')) t(event_id, ts, user_id, event_type)"""
    got = dict(same("ttl_cache_replay", events=events))
    assert [got[i] for i in "0123"] == ["miss", "hit", "hit", "evict"] and [got["9"], got["4"]] == ["miss", "hit"]
    assert "10" not in got and len(got) == 14


#: A word for each place and sign of the encoder.
WORD = {encode._place(w): w for w in (f"w{i}" for i in range(4000))}


def text(*counts):
    """A text with these (place, count) in the encoder's vector."""
    return " ".join(" ".join([WORD[p, 1 if n > 0 else -1]] * abs(n)) for p, n in counts)


def encoded(items, docs):
    table = lambda key, texts: "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in texts.items()) + f") t({key}, text)"
    return {"benchmark": table("item_id", items), "documents": f"SELECT *, 'en' AS lang FROM ({table('doc_id', docs)})"}


def test_encoded_ties_and_texts_that_cancel(same):
    # lengths 16 and 8, product 1: the cosine is 0.0078125, halfway between two scores
    item, doc = text((0, 1), (1, 15), (2, 5), (3, 2), (4, 1)), text((0, 1), (5, 7), (6, 3), (7, 2), (8, 1))
    tables = encoded({1: item, 2: text((0, 1), (0, -1)), 3: "", 4: text((5, 1))}, {1: doc, 2: text((0, 1), (0, -1)), 3: "", 4: text((1, 1)), 5: text((0, -1), (5, 2))})
    got = {(r[0], r[1]): r[2:] for r in same("encoded_topk", **tables)}
    assert got["1", "1"][0] == "0.007813" and got["1", "2"] == ["nan", "1"] and got["4", "2"][0] == "0.0"


def test_embedding_of_texts_that_cancel(same):
    # 2 of 640 is 0.003125, halfway between two totals; its parts are no binary fractions
    parts = enumerate((-111, -264, -191, 189, -148, 481, 46))
    got = same("embedding_job", **encoded({1: ""}, {1: text((0, 1), (0, -1)), 2: "", 3: text((0, 1), (1, 2)), 4: text(*parts)}))
    assert [r[1] for r in got] == ["nan", "0.0", "1.34164", "0.00313"]


def test_fusion_of_texts_that_cancel(same):
    tables = encoded({1: text((0, 1), (1, 2)), 2: text((2, 3))}, {i: text((0, 1), (i % 5, 1), (5, i)) for i in range(1, 12)} | {12: text((0, 1), (0, -1))})
    got = {(r[0], r[1]): r[2:] for r in same("rrf_fusion", **tables)}
    assert got["1", "12"][1] == "1"


def test_metrics_with_texts_that_cancel(same):
    item = f"{WORD[0, 1]} alpha beta gamma"
    got = same("eval_recall_mrr_ndcg", **encoded({1: item}, {1: f"x {item} y", 2: text((0, 1), (0, -1)), 3: "other words"}))
    assert got == [["1", "1", "1.0", "1.0", "0.5", "0.63093"]]
