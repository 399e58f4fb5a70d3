"""Tiles of a similarity matrix are dealt once for each strip."""

from rillworks.operators import vector_blocks as vb


def test_a_tile_goes_once_to_each_strip(spark):
    n, strip = 24, 6
    packed = spark.createDataFrame([(i, [i], bytes(8)) for i in range(n)], "tile long, ids array<long>, x binary")
    close = spark.createDataFrame([(i, j) for i in range(n) for j in range(i, n)], "i long, j long")
    rows = vb.dealt_tiles(packed, close, strip).collect()
    tiles = [(r.si, r.sj, r.tile) for r in rows if r.others is None]
    assert len(tiles) == len(set(tiles)) == n * n // strip  # before: two for each of 300 pairs
    met = sorted((r.tile, j) for r in rows for j in r.others or ())
    assert met == [(i, j) for i in range(n) for j in range(i, n)]
    assert all({(r.si, r.sj, t) for t in (r.tile, *r.others)} <= set(tiles) for r in rows if r.others)
