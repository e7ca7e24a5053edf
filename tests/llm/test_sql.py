import duckdb
import pyarrow as pa
import pytest

from strandlake.llm import ngram_join, substring_dedup
from strandlake.llm.queries import ORACLE_SQL, QUERIES

from .test_ngram_join import brute as groups
from .test_substring_dedup import brute as passages


@pytest.fixture(scope="module")
def short(rows):
    """Without the very long text: unnesting repeats its words for each of its places."""
    return [r for r in rows if len(r[1] or "") < 5000]


@pytest.fixture(scope="module")
def con(short):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in short], "text": pa.array([r[1] for r in short], pa.string())}))
    return con


def test_names_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, len(QUERIES) + 1)]


def test_join_sql(con, short):
    got = {r[0]: tuple(r[1:]) for r in con.sql(ngram_join.OP4_SQL).fetchall()}
    assert got == groups([r[:2] for r in short], ngram_join.WORDS, ngram_join.PERCENT)


def test_substring_sql(con, short):
    got = {r[0]: tuple(r[1:]) for r in con.sql(substring_dedup.OP6_SQL).fetchall()}
    assert got == passages([r[:2] for r in short], substring_dedup.WINDOW)
