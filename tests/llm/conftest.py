import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers import the operators by name
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) pairs, with a column whose name clashes with those that operators make."""
    def make(rows, langs=None):
        full = [(i, t, langs[k] if langs else "en", "s", None) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        for clash in ("fp", "digest", "row", "kept", "score", "component_id", "length", "html", "key"):
            df = df.withColumn(clash, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang) of the smallest documents table, and some hard cases behind it."""
    import duckdb

    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    hard = [None, "", " ", "\n\n\t", "a", "é", "x" * 30_000, " " * 5_000 + "y", "no<|endoftext|>space <|endoftext|> space<|startoftext|>", "tab\tand\x0bmore\x0c\r\n  end  ",
            " hard spaces　here\x1cand\x85there", "é combining ẛ̣ marks", "ΑΣ Σ ΣΑΣ", "I'll we've IT'S 'S", "日本語の文章です。" * 400, "🙂🙃 👩‍👩‍👧" * 50, "1234567890 ١٢٣ ½ ² Ⅷ",
            "ab" * 3 + " word" * 9_000, "line\n" * 4_000, "\u0000�​"]
    return [(i, t, lang) for i, t, lang in rows] + [(10_000 + i, t, None) for i, t in enumerate(hard)]
