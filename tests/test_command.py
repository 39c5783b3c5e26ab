import os

from seekloom.__main__ import main
from seekloom.sources.files import mixed

from .test_engine import DOCX


def _write(root, name, data):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(data)


def test_mixed_folders(spark, tmp_path):
    for name, data in {"a.md": b"one\ntwo", "d/b.docx": DOCX, "bad.docx": b"no", "c.bin": b"x", "e.txt": b"\xff\xfe", ".git/f.md": b"hidden"}.items():
        _write(tmp_path, name, data)
    records, files = mixed(spark, str(tmp_path))
    paths = {x.file_id: (x.path, x.content_searchable) for x in records.collect()}
    assert {paths[x.file_id][0]: x.text for x in files.collect()} == {"a.md": "one\ntwo", "d/b.docx": "DOCX Alpha\nDOCX Beta & Café\nFoot"}
    assert sorted(p for p, known in paths.values() if known) == ["a.md", "d/b.docx"]
    assert {"bad.docx", "c.bin", "e.txt", "d"} <= {p for p, known in paths.values() if not known}


def test_the_command_line(spark, tmp_path, capsys):
    root, store = tmp_path / "in", str(tmp_path / "store")
    _write(root, "a.md", b"an ink pen\nand paper")
    _write(root, "d/b.docx", DOCX)

    def say(*args):
        code = main([*args, "--store", store], spark)
        out = capsys.readouterr()
        return code, (out.out + out.err).strip()

    assert say("status")[0] == 2
    assert say("init", "--root", str(root))[1].startswith("initialised generation=1 base=1 records=3 changes=0")
    assert say("init", "--root", str(root)) == (2, "error: the store has a catalog already")
    assert say("search", "INK")[1].startswith("a.md: ") and say("search", "beta")[1].startswith("d/b.docx: ")
    assert say("search", "p[ae]n", "--kind", "regex", "--file", "a.md")[1].startswith("a.md: ")
    assert say("search", "--file", "b.docx") == (0, "d/b.docx") and say("search", "quill") == (0, "")
    assert say("update", "--root", str(root))[1].startswith("unchanged")
    _write(root, "a.md", b"a quill")
    os.utime(root / "a.md", ns=(10**18, 10**18))
    assert say("update", "--root", str(root))[1].startswith("updated")
    assert say("search", "quill")[1].startswith("a.md: ") and say("search", "ink pen") == (0, "")
    assert main(["init", "--root", str(root), "--store", str(root / "s")], spark) == 2
    assert main(["helpers"], spark) == 0 and "pdftotext" in capsys.readouterr().out
