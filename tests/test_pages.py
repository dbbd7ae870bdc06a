import pytest
from pyspark.sql import functions as F

from corpusloom.plans.corpus_build import BuildOptions, build_corpus
from corpusloom.session import scratch_path
from corpusloom.sources.documents import read_text_files
from corpusloom.sources.pages import holds, last_page, list_pages, read_pages, write_text_files
from corpusloom.sources.releases import entries

FILES = {
    "top.txt": "top", "2402/d.txt": "d", "2403/a.txt": "one\ntwo\n", "2403/b.txt": "é", "2403/deep/er/e.txt": "e", "24031/c.txt": "c",
    "2403/skip.md": "no", "2403/_SUCCESS.txt": "", "2403/.hidden.txt": "", "_tmp/x.txt": "x", "2404/a b%20.txt": "blank",
}
SHOWN = {name for name in FILES if name.endswith(".txt") and "/_" not in name and "/." not in name and name[0] != "_"}


@pytest.fixture
def papers(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "in put" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path / "in put")


def names(files):
    return {r.relative for r in files.collect()}


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "{}/"])
def test_lists_every_level(spark, papers, form):
    rows = list_pages(spark, form.format(papers), ["2403"], "*.txt").collect()
    assert {r.relative for r in rows} == SHOWN and len(rows) == len(SHOWN)
    one = next(r for r in rows if r.relative == "2403/a.txt")
    assert (one.folder, one.folder_ord, one.bytes, one.path) == ("2403", 0, 8, form.format(papers).rstrip("/") + "/2403/a.txt")


def test_prefixes_are_strings_and_list_once(spark, papers):
    assert names(list_pages(spark, papers, pattern="*.txt", prefixes=["2403", "24031", "2403/a"])) == {
        "2403/a.txt", "2403/b.txt", "2403/deep/er/e.txt", "24031/c.txt",
    }
    assert names(list_pages(spark, papers, prefixes=["none"])) == set()


@pytest.mark.parametrize("after", ["", "2402", "2402/d.txt", "2403", "2403/", "2403/b.txt", "2403/deep", "2403/deep/er/e.txt", "2403/z", "24031/c.txt", "zz"])
def test_after_a_page(spark, papers, after):
    assert names(list_pages(spark, papers, pattern="*.txt", after=after)) == {name for name in SHOWN if name > after}


def test_directories_before_the_page_stay_closed():
    assert not holds("2402", (), "2403/b.txt") and not holds("2403/a", (), "2403/b.txt")
    assert holds("2403", (), "2403/b.txt") and holds("24031", (), "2403/b.txt") and holds("", (), "zz")
    assert holds("24", ("24/03",), None) and not holds("25", ("24/03",), None)


def test_reads_what_the_text_reader_reads(spark, papers):
    files = list_pages(spark, papers, pattern="*.txt")
    got = {(r.relative, r.text) for r in read_pages(files).join(files.withColumnRenamed("path", "file_name"), "file_name").collect()}
    assert got == {(name, FILES[name]) for name in SHOWN}
    assert {r.text for r in read_text_files(spark, papers, (), "*.txt").collect()} == {text for _, text in got}


def test_gone_and_broken_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("gone.txt", "bad.txt"):
        (tmp_path / "in" / name).write_bytes(b"a\xffb")
    files = list_pages(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "gone.txt").rename(tmp_path / "moved.txt")
    assert [r.text for r in read_pages(files).collect()] == ["a\ufffdb"]
    assert files.count() == 2


def test_empty_and_missing_roots(spark, tmp_path):
    files = list_pages(spark, str(tmp_path))
    assert files.count() == 0 and last_page(files) is None and read_pages(files).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        list_pages(spark, str(tmp_path / "nowhere"))


def test_second_run_takes_the_new_page(spark, tmp_path):
    for name in ("2401/a.txt", "2401/b.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("One sentence. Another one.")
    out, root = scratch_path(spark, "t-pages"), str(tmp_path / "in")
    first = list_pages(spark, root)
    build_corpus(spark, first, read_pages(first), out, BuildOptions())
    (tmp_path / "in" / "2402").mkdir()
    (tmp_path / "in" / "2402" / "c.txt").write_text("A third.")
    second = list_pages(spark, root, after=last_page(first))
    assert names(second) == {"2402/c.txt"}
    build_corpus(spark, second, read_pages(second), out, BuildOptions())
    assert {r.n for r in entries(spark, out).groupBy("path").agg(F.count("*").alias("n")).collect()} == {1}
    assert entries(spark, out).count() == 3


def test_a_file_for_each_row(spark, tmp_path):
    """Rows of one name have files of their own, and only the folders above the files are directories."""
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 12, None), ("b:", 3, "é\ny"), (None, 4, "z")], "folder string, id long, text string")
    root = str(tmp_path / "out")
    assert write_text_files(rows.repartition(3), root, ("folder", "id")) == 5
    files = list_pages(spark, root, pattern="*.txt")
    got = sorted((r.file_name.removeprefix(root + "/").split(".")[0], r.text) for r in read_pages(files).collect())
    assert got == [
        ("folder=__HIVE_DEFAULT_PARTITION__/id=4", "z\n"), ("folder=a/id=1", "x\n"), ("folder=a/id=1", "x\n"), ("folder=a/id=12", "\n"),
        ("folder=b%3A/id=3", "é\ny\n"),
    ]
    assert {path.name for path in (tmp_path / "out").rglob("*") if path.is_dir()} == {"folder=__HIVE_DEFAULT_PARTITION__", "folder=a", "folder=b%3A"}
