"""Registered queries against their SQL, on the smallest tables; a few that stand for the rest."""

import os

import duckdb
import pytest

from cladeflow.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["p1_letter_to_mask", "a3_forced_weight", "a4_site_summary", "w2_symbol_recoding", "w4_onset", "w5_rest_bound", "j5_blocked_site_pairs", "t7_enumeration", "t3_placements", "s5_s6_nexus_round_trip", "s11_partition_statistics", "h1_spanning_tree", "h5_incompatibility_bound", "h6_part_bounds", "h7_two_way_scores", "h13_s7_real_bounds", "o2_max_min_order", "j7_incompatible_ambiguous", "t6_exact_search", "s2_rejected_texts"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in ("events", "documents", "embeddings", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    told = db.execute(ORACLE[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(tuple(map(str, r)) for r in told.fetchall())
    assert sorted(tuple(map(str, r)) for r in found.select(columns).collect()) == expected and expected


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
