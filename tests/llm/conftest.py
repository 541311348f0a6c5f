import pytest

#: Columns whose names the operators use themselves.
CLASHING = "score double, kept boolean, key string, node bigint, label bigint, name bigint, block int, salt int, h bigint, topic string, tokens bigint, rank int, fp binary, __id bigint, _chance double, _source string, _topic string, _gap double, before int, component bigint"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""
    def make(rows):
        width = len(SCHEMA.split(","))
        full = [(*r, *["en", "s"][len(r) - 2:], len(r[1] or "")) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame([(*r, *[None] * (width - 5)) for r in full], SCHEMA)
    return make


#: Null and empty texts, null ids, repeated rows, ties and one very long text.
ODD = [(1, "Same TEXT here"), (2, "same text HERE"), (3, None), (4, ""), (5, " \t\n"), (None, "no id at all"), (None, "same text here"),
       (7, "word"), (7, "word"), (8, "É accent"), (9, "é accent"), (10, "long words " * 30000), (11, "long words " * 30000), (12, "long words " * 29999 + "long wordz")]
