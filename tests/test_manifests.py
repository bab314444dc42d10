from __future__ import annotations

import pytest

from contextloom.functions.manifests import manifest_section
from contextloom.operators.workflows import manifest_sections
from contextloom.sources.documents import output_path, part_path, write_documents, write_text


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a/Makefile", "all: x\n\techo\ntest:\nall:\n.PHONY: all\n", "Available targets:\n- `all`\n- `test`\n"), ("package.json", '{"name": "n", "scripts": {"b": "2", "a": "1"}}', "Package: n\nScripts:\n- `a`: `1`\n- `b`: `2`\n"),
        ("go.mod", "module x/y\n\ngo 1.22\n", "Module: x/y\nGo version: 1.22\n"), ("Cargo.toml", '[package]\nname = "c"\nversion = "1"\n[dependencies]\nname = "z"\n', "Crate: c\nVersion: 1\n"),
        ("pyproject.toml", '[project]\nname = "p"\n', "Project: p\n"), ("package.json", "[1]", ""), ("package.json", "{bad", ""), ("Cargo.toml", "= bad", ""), ("x.py", "a: 1", ""), (None, None, ""), ("Makefile", "", ""),
    ],
)
def test_sections(path, text, want):
    assert manifest_section(path, text) == want


def test_rows(make_files):
    df = make_files((1, "r", "Makefile", "go:\n"), (1, "r", "Makefile", "go:\n"), (2, "r", "b.py", "x"), (3, "r", "go.mod", None), (4, "r", "package.json", "{}"))
    assert [(r.path, r.section) for r in manifest_sections(df).collect()] == [("Makefile", "Available targets:\n- `go`\n")]


def test_writing(spark, tmp_path):
    assert str(output_path("", "p", "xml")) == "p.xml" and str(output_path("f.txt", "p")) == "f.txt"
    assert part_path(output_path("a/b"), 2, 3).name == "b.part-002.md" and part_path(output_path("b"), 1, 1).name == "b.md"
    docs = spark.createDataFrame([("o/r", "# héllo\n"), ("o/s", "")], "repo string, document string")
    assert set(write_documents(docs, tmp_path)) == {"o__r.md", "o__s.md"} and (tmp_path / "o__r.md").read_text() == "# héllo\n"
    (tmp_path / "parts").mkdir()
    parts = spark.createDataFrame([("o/r", 1, "a"), ("o/r", 2, "b"), ("s", 1, "c")], "repo string, part_no int, document string")
    assert set(write_documents(parts, tmp_path / "parts")) == {"o__r.part-001.md", "o__r.part-002.md", "s.md"}
    with pytest.raises(FileNotFoundError):
        write_text(tmp_path / "no" / "x.md", "a")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["o__r.md", "o__s.md", "parts"]
