"""Text files: written by parts, listed by parts, each opened once."""

import re

from marginalia.plans import sinks
from marginalia.sources import tables as S


def test_files_are_written_by_parts_and_read_once(spark, data):
    found = sinks.text_files(spark, data)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    files = found.inputFiles()
    assert len(files) == found.count() and all(re.search(r"/part=\d+/source=src\d+/[^/]+$", f) for f in files)


def test_texts_and_rejects_are_those_of_one_reading(spark, tmp_path):
    blank = {"a.md": b" ", "b.txt": b" \t\r\n\x0b\x0c\r", "c.txt": b"\n"}
    whole = {"d.txt": b"\r\r\n\nx", "e.md": " ".encode(), "f.markdown": b" . "}
    for name, content in (blank | whole).items():
        (tmp_path / name).write_bytes(content)
    read = {r.path.rpartition("/")[2]: (r.text, r.reason) for r in S.read_texts(spark, str(tmp_path)).collect()}
    assert {k for k, (_, reason) in read.items() if reason == "empty"} == set(blank)
    assert {k: text for k, (text, reason) in read.items() if reason is None} == {"d.txt": "\n\n\nx", "e.md": " ", "f.markdown": " . "}
    docs, rejects = S.read_text_documents(spark, str(tmp_path))
    assert docs.columns == ["path", "text"] and sorted(r.text for r in docs.collect()) == sorted(["\n\n\nx", " ", " . "])
    assert {(r.path.rpartition("/")[2], r.reason) for r in rejects.collect()} == {(k, "empty") for k in blank}
