"""Every query against its SQL on the smallest data; and again as if all of it were large and skewed."""

import os

import pytest

from checks.oracle import ORACLE
from checks.registry import QUERIES
from linestream import scale
from scripts.check_oracle import oracle_rows, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

# Those with a join on a key or an ordered scan that has a second way for large and skewed tables.
TWO_WAYS = [
    "clip_rects", "tm_lookup", "pending_lines", "topmost_window_at", "drop_stale_responses", "line_identity",
    "carry_forward", "changes_only", "session_state", "availability_status", "debounce_last_flush",
    "interaction_spans", "lexicon_translate", "translate_batches", "split_sections", "unique_slugs",
    "replay_live", "replay_live_session_cache", "replay_live_auto", "translate_capture", "live_epochs",
    "drop_stale_responses_control", "topmost_window_at_snapshots", "max_overlap_display_snapshots",
    "interaction_spans_begin_end",
]


def check(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cols, want = oracle_rows(SF, ORACLE[name])
    assert sorted(cols) == sorted(df.columns)
    assert got == want and got


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    check(spark, name)


@pytest.mark.parametrize("name", TWO_WAYS)
def test_query_on_hot_keys(spark, name, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 8)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    check(spark, name)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["session_id", "frame_seq", "translation"] and df.count() == 200
