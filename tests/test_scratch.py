"""Staged tables go when the job that made them ends, and no others."""

import os
import warnings

import pytest

from palaver.session import scratch_path, scratch_tables, shared_dir, stage


def _folders(spark):
    root = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(root))


def test_staged_tables_are_removed(spark):
    outside = stage(spark.range(3), "outside")
    before = _folders(spark)
    with scratch_tables(spark):
        kept = stage(spark.range(4), "kept", keep=True)
        gone = stage(spark.range(5), "gone")
        with scratch_tables(spark):
            inner = stage(gone, "inner")
            assert inner.count() == 5
        assert gone.count() == 5
        during = _folders(spark) - before
    after = _folders(spark) - before
    assert len(during) == 2 and len(after) == 1 and next(iter(after)).startswith("palaver-kept-")
    assert outside.count() == 3 and kept.count() == 4
    later = stage(spark.range(6), "later")
    assert later.count() == 6


def test_a_failed_job_leaves_nothing(spark):
    before = _folders(spark)
    with pytest.raises(ValueError, match="bad"), scratch_tables(spark):
        stage(spark.range(3), "half")
        raise ValueError("bad")
    assert _folders(spark) == before


def test_a_path_never_written_is_no_error(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        with scratch_tables(spark):
            scratch_path(spark, "unused")
