"""The registered SQL against brute force, on the same odd corpora as the queries."""

import duckdb
import pandas as pd
import pytest

from tessera.llm.oracles import SQL
from tests.llm import brute
from tests.llm.test_contracts import CASES, corpus

NAMES = {name.split("_")[0]: name for name in SQL}


def answer(op, table, key, value, rows):
    data = duckdb.connect()
    data.register("given", pd.DataFrame(rows, columns=[key, value]).astype({key: "int64"}))
    data.execute(f"CREATE VIEW {table} AS SELECT {key}, {value}::VARCHAR AS {value} FROM given")
    return data.sql(SQL[NAMES[op]])


@pytest.mark.parametrize("op", CASES)
def test_documents(op):
    docs = corpus(21)
    got = answer(op, "documents", "doc_id", "text", docs).select(*CASES[op][2]).fetchall()
    assert sorted(got) == getattr(brute, op)(docs)


def test_pages():
    pages = corpus(22)
    got = answer("op6", "pages", "page_id", "html", pages).fetchall()
    assert sorted(got, key=lambda r: r[0]) == brute.op6(pages)
