"""Manifests: each file is CSV or a list as a whole."""

from sievework.sources import readers


def test_manifest(spark, tmp_path):
    files = {"a.txt": "source list\n# note\n\n sourceforge.net/x \nhttp://a.org\n", "b.csv": 'Source,title\n"x, y",T\n#kept,T\n  ,T\nz,"a, b"\n"q ""r""",T\r\n'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    assert sorted(r.source for r in readers.manifest(spark, str(tmp_path / "a.txt")).collect()) == ["http://a.org", "source list", "sourceforge.net/x"]
    assert sorted(r.source for r in readers.manifest(spark, str(tmp_path / "b.csv")).collect()) == ["#kept", 'q "r"', "x, y", "z"]


def test_atom_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.1</id><title>T</title><published>2024-01-02</published></entry></feed>')
    assert [(r.arxiv_id, r.year, r.pdf_url) for r in readers.atom(spark, str(tmp_path / "feed.xml")).collect()] == [("2401.1", 2024, "https://arxiv.org/pdf/2401.1")]


def test_whole_files_are_read(spark, tmp_path):
    (tmp_path / "list").write_text("first\n# no\n\nsecond, third\n")
    (tmp_path / "feed").mkdir()
    feed = '<feed xmlns="http://www.w3.org/2005/Atom">\n<entry>\n<id>http://arxiv.org/abs/2401.1</id>\n<title>A\nB</title>\n<published>2024-01-01</published>\n</entry>\n</feed>\n'
    (tmp_path / "feed" / "f.xml").write_text(feed)
    # a comma anywhere makes the whole file one of CSV
    assert sorted(r.source for r in readers.manifest(spark, str(tmp_path / "list")).collect()) == ["# no", "first", "second"]
    assert [(r.title, r.arxiv_id) for r in readers.atom(spark, str(tmp_path / "feed")).collect()] == [("A B", "2401.1")]
