import json
import os

import pytest

from sparkloom.errors import SchemaError
from sparkloom.operators import chunk
from sparkloom.sources.files import read_documents
from sparkloom.sources.transfer import import_graph


def test_files_of_each_kind(spark, tmp_path):
    files = {
        "a.md": "# Title\n\ntext", "b.txt": "plain", "c.json": json.dumps([{"text": "one", "source": "s1", "metadata": {"k": 1}}, {"text": "two"}]), "d.json": json.dumps({"documents": [{"text": "three"}]}),
        "e.jsonl": '{"text": "four", "source": "s4"}\n\nbroken\n{"other": 1}\n', "f.json": "{broken", "g.exe": "x",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    docs, warnings = read_documents(spark, [f"{tmp_path}/{name}" for name in [*files, "missing.md"]])
    found = {r["text"]: r for r in docs.collect()}
    assert set(found) == {"# Title\n\ntext", "plain", "one", "two", "three", "four"}
    assert found["plain"]["source"] == f"{tmp_path}/b.txt" and found["one"]["source"] == "s1" and found["two"]["source"] is None
    said = sorted(os.path.basename(w.split(": ")[0]) + ": " + w.split(": ")[1] for w in warnings)
    assert said == ["e.jsonl: 2 lines are no documents", "f.json: not a list of documents", "g.exe: unsupported kind .exe", "missing.md: not found"]


def test_sources_have_one_name(tmp_path):
    here = os.path.realpath(".")
    assert chunk.normalized_source("./x/../y.md") == f"{here}/y.md" and chunk.normalized_source("https://a/../b") == "https://a/../b" and chunk.normalized_source(None) is None


@pytest.mark.parametrize(("lines", "what"), [(['{"type": "node"}'], "header"), (['{"type": "graph_export", "format_version": 99}', '{"type": "schema", "node_tables": [], "rel_tables": []}'], "newer")])
def test_imports_need_a_header_they_know(spark, tmp_path, lines, what):
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    with pytest.raises(SchemaError, match=what):
        import_graph(spark, f"{tmp_path}/in.jsonl")


def test_chunk_rules():
    text = "First paragraph here.\n\n \nSecond one. It has two sentences.\n\n" + "long " * 12 + "end."
    assert chunk.split_text(text, 40, 0) == ["First paragraph here.", "Second one. It has two sentences.", "long long long long long long long long", "long long long long end."]
    assert chunk.split_text(text, 40, 12)[1] == "here. Second one. It has two sentences." and all(len(c) <= 40 for c in chunk.split_text(text, 40, 12))
    assert chunk.split_text("aaa bbb. ccc ddd. eee fff.", 18, 8) == ["aaa bbb. ccc ddd.", "ddd. eee fff."]
    assert chunk.split_text("abcdefghij" * 3, 8, 0) == ["abcdefgh", "ijabcdef", "ghijabcd", "efghij"] and chunk.split_text("  \n\n ", 10, 0) == []
    assert chunk.split_text("a b", 0, 5) == ["a", "b"]
