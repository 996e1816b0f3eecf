"""CRF spans that reach beyond base spans are redacted too."""

import numpy as np
import pytest

from tessera.llm import secrets


def clean(text, tagger):
    raw = text.encode()
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": [text]})
    (spans,) = secrets.scan_rows(rows, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tagger)
    return spans, secrets.redacted(text, spans)


@pytest.fixture(scope="module")
def tagger():
    return secrets.Tagger(*secrets.trained())


@pytest.mark.parametrize("sign", "!@$")
def test_values_with_signs(tagger, sign):
    line = f"on the old host set the password: aB3dE6gH9{sign}kL2mN5pQ8 and go on"
    spans, text = clean(line, tagger)
    assert [s for s in spans if s[1] != "crf"] == secrets.base_spans(line)
    assert text == "on the old host set the [secret] and go on"


def test_multi_line_key(tagger):
    lines = ["MIIEpAIBAAKCAQEA7bq9Xk3vN2Rz8fYw1cT5uLhJ6sDgP0oVmEiBnKxWyQaZtCrH", "deadbeefdeadbeefdeadbeefdeadbeef" * 2, "q8Zr5TnVb3LxKf7Jm2PwYc9Hs4Dg6RtE1uIoAvNkXzBjQyWlCe0SpMhUdFiGa+/x"]
    _, text = clean("see -----BEGIN " + "\n".join(lines) + "\nand more prose", tagger)
    assert not any(line in text for line in lines) and "MIIEpAIB" not in text and "q8Zr5TnV" not in text


def test_a_span_inside_a_base_span_is_dropped(tagger):
    spans, text = clean("password=aB3dE6gH9kL2mN5pQ8sT1vW4 x", tagger)
    assert [s[1] for s in spans] == ["assign"] and text == "[secret] x"
