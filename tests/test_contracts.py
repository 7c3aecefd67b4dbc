import json

import pytest

from gustfield.operators import contracts as K

GOOD = {"schemaVersion": 1, "frame": "shooter", "azimuthDeg": 10, "rangesYards": [0, 5], "heightsAglFt": [2, 10], "uFps": None, "vFps": [[1, 2], [3, 4]], "wFps": None, "source": "x", "terrainResolutionM": None, "windSourceResolutionM": 10, "confidence": 0.5}


@pytest.mark.parametrize("change, code", [
    ({}, None), ({"schemaVersion": 2}, "unsupported-version"), ({"frame": "earth"}, "unsupported-frame"), ({"rangesYards": [5, 1]}, "malformed-axis"), ({"heightsAglFt": [-1001, 2]}, "out-of-range"),
    ({"vFps": [[1, 2]]}, "malformed-grid"), ({"wFps": [[0, 0], [0, 1]]}, "unsupported-vertical-wind"), ({"source": ""}, "malformed-field"), ({"confidence": 2}, "out-of-range"), ({"azimuthDeg": 400}, "out-of-range"), ({"extra": 1}, "unknown-field"), ({"vFps": [[1, 2], [3, 400]]}, "out-of-range"), ({"heightsAglFt": [-1, 2]}, None), ({"source": "x" * 201}, "malformed-field"),
    # what comes first in the document names the code
    ({"rangesYards": [-1, 5, 3]}, "out-of-range"), ({"rangesYards": [1, 0, -5]}, "malformed-axis"), ({"vFps": [[999, 2], [3]]}, "out-of-range"), ({"vFps": [[1, "2"], [999, 3]]}, "malformed-grid"), ({"schemaVersion": True}, "unsupported-version"), ({"schemaVersion": 1.0}, None), ({"heightsAglFt": []}, "malformed-axis"), ({"uFps": {}}, "malformed-grid"), ({"wFps": [[0, 1e-7], [0, 0]]}, None),
])
def test_first_failure(change, code):
    assert K.failure(json.dumps(GOOD | change)) == code


def test_missing_and_azimuth():
    assert K.failure(None) == "not-an-object" and K.failure("[1]") == "not-an-object" and K.failure("{}") == "missing-field"
    assert K.failure(json.dumps({k: v for k, v in GOOD.items() if k != "uFps"})) == "missing-field"
    text = json.dumps(GOOD)
    assert K.failure(text, 10.5) is None and K.failure(text, 12.0) == "azimuth-mismatch" and K.failure(text, 400.0) == "out-of-range" and K.failure(text, float("nan")) == "azimuth-missing"


def test_nesting(spark):
    rows = spark.createDataFrame([(1, 10.0, 5.0, 4.0), (1, 2.0, 0.0, 1.0), (1, 2.0, 5.0, 2.0), (1, 10.0, 0.0, 3.0)], "id int, h double, r double, u double")
    r = K.nested(rows, ["id"], "h", "r", ["u"]).first()
    assert (r.heights, r.ranges, r.u) == ([2.0, 10.0], [0.0, 5.0], [[1.0, 2.0], [3.0, 4.0]])
