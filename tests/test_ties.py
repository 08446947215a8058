"""Queries whose rows tie: the same rows in another order give the same result, and it is the statement's."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

from .oracle import compare, connection

SF = "/root/testdata/sf0.001"
TIED = "answer_requests canonical_first consolidated_notes context_reuse filled_answers ranking_labels progress_windows teacher_left_join top1_errors trajectory_plots teacher_agreement"


@pytest.fixture(scope="module", params=["ASC", "DESC"])
def tied(request, tmp_path_factory):
    """The smallest tables, but every order's lines have one number and price, as they lie or turned."""
    at = tmp_path_factory.mktemp("tied")
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", at / name)
    rows = f"SELECT * REPLACE (1 AS l_linenumber, 100.0 AS l_extendedprice, (l_quantity % 3)::DOUBLE AS l_quantity) FROM '{SF}/lineitem.parquet' ORDER BY l_partkey {request.param}, l_suppkey {request.param}"
    duckdb.sql(f"COPY ({rows}) TO '{at}/lineitem.parquet'")
    return str(at)


@pytest.mark.parametrize("name", TIED.split())
def test_ties_leave_nothing_to_chance(spark, tied, name):
    assert compare(connection(tied), entry.queries()[name](spark, tied), entry.oracle_sql()[name]) == ""
