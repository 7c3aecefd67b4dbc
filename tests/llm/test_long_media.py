"""The feature of media of several images tells of all of them."""

import numpy as np

from gustfield.llm import media


def test_feature_covers_all_images(spark):
    one = media.ROW * media.ROWS
    r = np.random.default_rng(5)
    first, a, b = (r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (one, one, one))
    rows = [(1, bytearray(media.encode_payload(first + a))), (2, bytearray(media.encode_payload(first + b))), (3, bytearray(media.encode_payload(first)))]
    got = {x.doc_id: x for x in media.features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].feature != got[2].feature and got[1].images == got[2].images == 2
    assert (got[1].width, got[1].height) == (got[3].width, 2 * got[3].height)
    whole = np.frombuffer(first + a, np.uint8).reshape(-1, media.ROW)
    assert got[1].feature == f"{got[1].width}x{got[1].height}x2:{media.difference_hash(whole):016x}"
