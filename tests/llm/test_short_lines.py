from llm.line_dedup import dedup_lines
from llm.queries import op4_line_dedup
from tests.llm import brute


def test_equal_lines_go_however_short_but_edits_need_five_words(spark):
    rows = [
        (1, "All rights reserved.\na b c d\n\nx"), (2, "All  rights reserved.\na b c e\n\n 全角的一行没有空格 \ny"), (3, "全角的一行没有空格\nx\n \nb c d\na b c d e"),
        (4, "All rights reserved. x\na b c d f\na b c d"), (None, "y"),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: (rows[0][1], 4, 0), 2: ("a b c e\n\n 全角的一行没有空格 \ny", 5, 1), 3: (" \nb c d\na b c d e", 5, 2), 4: ("All rights reserved. x", 3, 2), None: ("", 1, 1),
    }


def test_query_against_plain_equality(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    near, seen, want = brute.kept_lines(rows), set(), {}
    for k, (ident, text) in enumerate(rows):
        want[ident] = 0
        for kept, line in zip(near[k], (text or "").split("\n")):
            w = tuple(brute.words(line))
            want[ident] += not kept or w in seen
            seen |= {w} - {()}
    assert {r.doc_id: r.n_removed for r in op4_line_dedup(spark, sf_dir).collect()} == want
