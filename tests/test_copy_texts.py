"""Queries on copy made of whole texts, on texts that the tables have few of."""

import duckdb
import pytest

from stallwright import plans

from .oracle import assert_same

WORDS = " ".join(f"w{i}" for i in range(30))


@pytest.fixture
def folder(tmp_path):
    """folder(texts) -> a folder whose documents are the texts."""

    def write(texts: list[str | None]) -> str:
        c = duckdb.connect()
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars INTEGER)")
        c.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, ?)", [(i, x, f"src{i % 5}", len(x or "")) for i, x in enumerate(texts)])
        c.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
        return str(tmp_path)

    return write


def test_repairs_of_sentences_that_no_issue_names(spark, folder):
    ends = f"{WORDS}\nThe,\n , spaced out \n,;\nlast, but not least,"
    claim = f"{WORDS}\n{WORDS}, and\nw5 alone, w20 alone,\nw5 w20,"
    short = "few words,\nno claim of an audit, "
    where = folder([ends, claim, short, f"{ends}。{claim}！\n\n\n,w3,", None, "", ",", f"{WORDS},"])
    assert_same(plans.queries()["repairs_of_texts"](spark, where), plans.oracle_sql()["repairs_of_texts"], where)


def test_copy_loop_does_each_thing_once(spark, folder):
    """What is looked for in a text must not be computed again for each word or fact."""
    lines = ["Size: 3", "Colour | red", "", "【特徴】", "no.1 and abs", "(Size): 4", "Size:3", " ・ Size: 5", "a" * 30 + ":" + "b", "サイズ重量", "the street", "ab s"]
    texts = ["\n".join(lines), "\n".join(reversed(lines)), "\n".join(lines[3:]) + "\nwarranty\x0b\n \t", None, "", "\n \n", "【キャスター】\nabspc\n" + "x\n" * 50, "No", "license 1 @ zz", "Size: 9\nSize: 3\nCOLOUR | blue | red", "pse\nPSE tsa ロック"]
    where = folder(texts * 2)
    for name in ("copy_loop_of_texts", "enrichments_of_texts"):
        assert_same(plans.queries()[name](spark, where), plans.oracle_sql()[name], where)
    plan = plans.queries()["copy_loop_of_texts"](spark, where)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert plan.count("regexp_replace(lower(") < 40, plan.count("regexp_replace(lower(")
