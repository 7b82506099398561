"""Queries over odd rows and long texts: tables of the smallest size with some rows more, against the SQL or a model."""

from __future__ import annotations

import glob
import os

import pytest

from corvane.plans import registry

DATA = "/root/testdata/sf0.001"
BLANK = ["", None, "  ", "\n", "a o", "é", "x", "7", "...", "\t"]


def with_rows(spark, folder, name, rows, schema):
    """A data directory in *folder* in which the table *name* has *rows* more, null in the other columns."""
    for p in glob.glob(f"{DATA}/*.parquet"):
        if os.path.basename(p) != f"{name}.parquet":
            os.symlink(p, folder / os.path.basename(p))
    t = spark.read.parquet(f"{DATA}/{name}.parquet")
    t.unionByName(spark.createDataFrame(rows, schema), allowMissingColumns=True).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def both(spark, folder, query):
    """Rows of the query and of its SQL, sorted."""
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    want = con.sql(registry.oracle_sql()[query])
    got = registry.queries()[query](spark, folder).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("query", ["fn_lexical_terms", "scan_normalized"])
def test_documents_without_words(spark, tmp_path, query):
    got, want = both(spark, with_rows(spark, tmp_path, "documents", [(9_000_000 + k + 4 * j, x) for j, x in enumerate(BLANK) for k in range(4)], "doc_id long, text string"), query)
    assert got == want


@pytest.mark.parametrize("lines", [60, 20_000])
def test_long_turns_stay_whole(spark, tmp_path, lines):
    text = "\n".join(f"line {k} of a turn that is longer than what a paragraph or a note may hold" for k in range(lines))
    got, want = both(spark, with_rows(spark, tmp_path, "conversations", [(9_000_000, 0, "user", "How long?"), (9_000_000, 1, "assistant", text)], "conv_id long, turn long, role string, text string"), "scan_note_files")
    assert got == want
