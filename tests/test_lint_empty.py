"""Texts that are empty or null have no count errors, as in the SQL of the two count queries."""

import check
import duckdb
import pytest

from bibliospark.operators import quality
from bibliospark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["latex_lint_counts", "latex_lint_report"])
def test_against_sql(spark, tmp_path, name):
    texts = ["", None, " ", "$", "$$", "a the b", "} \\& &", "\\begin{a}", "\\{ {", "plain"]
    rows = [(i, text, "en", "src1", len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    message, ok = check.compare(spark, con, name, str(tmp_path), QUERIES, ORACLES)
    assert ok, message


def test_full_lint_still_names_empty_code(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "$")], "id long, latex string")
    assert {r.id: r.errors for r in quality.latex_lint(rows).collect()} == {
        1: ["Empty LaTeX code"], 2: ["Empty LaTeX code"], 3: ["Unbalanced inline math decorators ($ sign count is odd: 1)"]}
