import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.llm.lines import remove_repeated_lines
from strideframe.llm.queries import op3_line_runs, oracle_sql


def plain(rows, min_words):
    """Lines that stay, by (row, line) order: a line goes where any run around it with enough words began earlier."""
    lines = [(i, t.split("\n")) for i, t in rows if t is not None]
    seen, out = set(), {}
    for i, own in lines:
        gone = set()
        counts = [len(x.encode().split()) for x in own]
        for p in range(len(own)):
            new = []
            for q in range(p, len(own)):
                run = tuple(own[p : q + 1])
                if run in seen and sum(counts[p : q + 1]) >= min_words:
                    gone |= set(range(p, q + 1))
                new.append(run)
            seen |= set(new)
        out[i] = "\n".join(x for p, x in enumerate(own) if p not in gone)
    return out


def test_odd_rows(odd_docs):
    out = remove_repeated_lines(odd_docs, min_words=50)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id not in (12, None)}
    assert texts[7] == "Other start.\nOther end." and "word5 " in texts[6]
    assert texts[3] is None and texts[4] == ""
    report = {r.doc_id: r for r in remove_repeated_lines(odd_docs, min_words=50, report=True).collect()}
    assert report[7].removed == [1] and report[7].n_lines == 3 and report[3].n_lines == 0
    # Of repeated rows one keeps its lines.
    short = remove_repeated_lines(odd_docs, min_words=5).filter("doc_id = 12").collect()
    assert [r.text for r in short] == ["", ""]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a b", "c", "d e f", "", "g h"]), min_size=0, max_size=14), min_size=1, max_size=8), st.integers(1, 6))
def test_any_lines(spark, texts, min_words):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    out = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=min_words)
    assert {r.doc_id: r.text for r in out.collect()} == plain(rows, min_words)


def test_query_against_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in op3_line_runs(spark, sf_dir).select("doc_id", "n_lines", "n_removed", "text_md5").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, text_md5 FROM ({oracle_sql()['op3_line_runs']})").fetchall())


@pytest.mark.parametrize("words", [1, 50])
def test_empty_table(no_docs, words):
    assert remove_repeated_lines(no_docs, min_words=words).count() == 0


def test_order_of_copies_does_not_follow_other_rows(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(9, f"nine\n{run}"), (1, f"one\n{run}")]
    for more in ([], [(50, "a"), (50, "b")], [(None, f"none\n{run}")], [(1, "x"), (9, f"again\n{run}")]):
        for order in (1, -1):
            out = remove_repeated_lines(spark.createDataFrame((rows + more)[::order], "doc_id long, text string").coalesce(1), min_words=50)
            texts = sorted(r.text for r in out.collect())
            assert f"one\n{run}" in texts and "nine" in texts and sum(run in t for t in texts) == 1


def test_maximal_runs_go_whole(spark):
    words = lambda n, c: " ".join(f"{c}{i}" for i in range(n))
    passage = [words(60, "a"), words(40, "b"), "", words(3, "c")]
    rows = [(1, "\n".join(["x", *passage, "y"])), (2, "\n".join(["u", *passage, "v"])), (3, "\n".join([words(40, "b"), "", words(3, "c")]))]
    out = {r.doc_id: r.text for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=50).collect()}
    assert out == {1: rows[0][1], 2: "u\nv", 3: rows[2][1]}


def test_hot_lines_and_windows(spark, monkeypatch):
    import strideframe.llm._common as common

    monkeypatch.setattr(common, "HOT", 5)
    run = "\n".join(" ".join(f"p{i}w{j}" for j in range(12)) for i in range(6))
    rows = [(i, f"own {i}\n\n{run}\n\nend {i}" if i % 3 else f"alone {i}\n\n\n") for i in range(60)]
    out = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=50)
    assert {r.doc_id: r.text for r in out.collect()} == plain(rows, 50)
