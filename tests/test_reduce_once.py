"""Parts of texts are weighed once, before they are dealt by ranges."""

from rillworks.operators import summarize


def test_parts_are_written_with_their_sizes(spark, monkeypatch):
    written, write = [], summarize.cut
    monkeypatch.setattr(summarize, "cut", lambda x, *n: written.append(x.columns) or write(x, *n))
    parts = spark.createDataFrame([(1, i, "word " * 30) for i in range(4)] + [(2, 0, "one")], "doc long, no long, text string")
    got = {r.doc: r.rounds for r in summarize.reduce_text(parts, "doc", "no", "text", lambda xs: ["x"] * len(xs), budget=40).collect()}
    assert sorted(got) == [1, 2] and got[2] == 1 < got[1]
    assert all("w" in columns for columns in written)  # before: sizes were told anew by each pass
