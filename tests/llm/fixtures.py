"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def awkward(spark):
    """Null and empty texts, null ids, repeated rows, a very long text, clashing extra columns."""
    long_text = "the quick brown fox " * 20_000
    rows = [
        (1, None, "en", "src0", None, 1, "a"),
        (2, "", None, "src0", 0, 2, "b"),
        (None, "no id here at all", "en", None, 17, 3, "c"),
        (4, "same row twice in here", "en", "src1", 22, 4, "d"),
        (4, "same row twice in here", "en", "src1", 22, 4, "d"),
        (5, long_text, "en", "src0", len(long_text), 5, "e"),
        (6, "   \n\t ", "fr", "src0", 6, 6, "f"),
        (7, "Ünïcode Straße \U0001f600 数据 \x00 end", "de", "src2", 30, 7, "g"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, id string")
