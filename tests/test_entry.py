from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__
from touchline import queries

SMALL = Path(__spark_entry__.SMALLEST)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_are_registered():
    known = __spark_entry__.queries()
    assert set(queries.queries()) <= set(known)
    assert set(__spark_entry__.oracle_sql()) <= set(known)


def test_the_library_imports_nothing_of_the_corpus_operators():
    root = Path(queries.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "llm" not in file.read_text()


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["filtered_vote", "interval_overlap_strict", "gap_split", "uniform_sample", "report_grouping_sets", "hota_alignment"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.execute(queries.oracle_sql()[name]).description]
    got = [tuple(r) for r in queries.queries()[name](spark, str(SMALL)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_modules_do_not_name_rows_that_the_readme_leaves_out():
    root = Path(__spark_entry__.__file__).parent
    scope = (root / "README.md").read_text().partition("## Scope")[2]
    missing = {row for line in scope.splitlines() if line.startswith("| ") for row in re.findall(r"\b[A-Z]\d\d(?:-[A-Z]\d\d)?", line.split("|")[1])}
    missing = {(a, k) for a, b, c in (re.match(r"([A-Z])(\d\d)(?:-[A-Z](\d\d))?", m).groups() for m in missing) for k in range(int(b), int(c or b) + 1)}
    assert {("H", 9), ("W", 24)} <= missing
    for module in (root / "touchline").rglob("*.py"):
        head = module.read_text().partition("\n\n")[0]
        named = [(a, int(b), int(c or b)) for a, b, c in re.findall(r"\b([A-Z])(\d\d)(?:-[A-Z](\d\d))?", head)]
        assert not [n for n in named for a, k in missing | {("L", 9)} if n[0] == a and n[1] <= k <= n[2]], module
