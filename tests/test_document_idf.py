"""idf in one pass over the texts, as of postings."""

from rillworks.operators import search


def test_idf_of_texts_as_of_postings(spark, monkeypatch):
    rows = [(1, "a b b"), (2, "A c"), (2, "a c"), (2, "a c d"), (3, None), (4, " "), (5, "é a"), (6, "c c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (docs, docs.where("doc_id <> 2"), docs.where("doc_id = 4")):
        want = {r.term: round(r.idf, 9) for r in search.idf_weights(search.encode_sparse(some)).collect()}
        written, write = [], search.cut
        monkeypatch.setattr(search, "cut", lambda x, *n: written.append(x.columns) or write(x, *n))
        got = {r.term: round(r.idf, 9) for r in search.document_idf(some).collect()}
        monkeypatch.setattr(search, "cut", write)
        assert got == want and written == [["term", "df"]]
    with_null = docs.where("doc_id <> 2").unionByName(spark.createDataFrame([(None, "a"), (None, "a")], docs.schema))
    assert len(search.document_idf(with_null).collect()) == 4
