"""Composition of texts over Arrow arrays."""

import pyarrow as pa

from marginalia.functions import text as T


def test_batches_stay_in_arrow():
    given = pa.array(["é", None, "ﬁ"] * 100)
    assert T.nfkc.func(given).to_pylist() == ["é", None, "fi"] * 100
    assert T.nfc.func(given).to_pylist() == ["é", None, "ﬁ"] * 100
    assert T.nfc.func(pa.array([], pa.string())).to_pylist() == []
