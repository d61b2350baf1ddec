import pytest

LONG = "".join(f"word{i} " for i in range(30_000))


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash with the operators' own."""
    def make(*rows):
        full = [(*r, *("en", "src")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        schema = "doc_id long, text string, lang string, source string"
        df = spark.createDataFrame(full, schema)
        extra = ("s", "r", "n", "key", "size", "hits", "mix", "language", "pii", "found", "counts", "_set", "_hash", "shard", "digest")
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in extra])
    return make


@pytest.fixture
def rows():
    """Rows by doc_id (or page_id) as dicts; repeated ids as a list."""
    def read(df):
        out = {}
        for row in df.collect():
            out.setdefault(row[0], []).append(row.asDict(recursive=True))
        return {k: v[0] if len(v) == 1 else v for k, v in out.items()}
    return read
