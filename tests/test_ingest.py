import pytest

from tallyreach.operators.quality import reject_count
from tallyreach.sources import delimited, storage
from tallyreach.sources.specs import FieldSpec, TableSpec

# Three tab-separated fields are expected. \n ends a line, \r\n as well; a lone \r is data.
LINES = (
    "a\t1\tx\n"
    "b\t2\n"
    "d\t1\t2\t3\n"
    '\td"q\t"z\n'
    "e\t\\N\t5\n"
    " c \tnull\t \n"
    " a\t null \t\n"
    "\t\t\n"
    "\n"
    "q\t1\tback\\tslash\\\r\n"
    "r\t1\tone\rtwo"
)
SPEC = TableSpec("t", ("t.csv",), "\t", tuple(map(FieldSpec, "abc")), ("a", "b"))


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "t.csv").write_bytes(LINES.encode())
    return str(tmp_path / "t.csv")


def test_good_lines(spark, raw):
    rows = delimited.parse(delimited.read_lines(spark, [raw]), list("abc"), "\t").collect()
    assert [tuple(row)[:3] for row in rows] == [
        ("a", "1", "x"),
        (None, 'd"q', '"z'),
        ("e", None, "5"),
        (" c ", None, " "),
        (" a", " null ", None),
        (None, None, None),
        ("q", "1", "back\\tslash\\"),
        ("r", "1", "one\rtwo"),
    ]
    assert {row["source_file"].rsplit("/", 1)[1] for row in rows} == {"t.csv"}


def test_typed_rows_and_flags(spark, raw):
    clean, _ = delimited.clean_table(delimited.read_lines(spark, [raw]), SPEC)
    rows = [(row["a"], row["b"], row["c"], row["identifier_is_valid"]) for row in clean.collect()]
    assert rows[3:6] == [
        ("c", None, None, False),
        ("a", "null", None, True),
        (None, None, None, False),
    ]
    assert clean.columns == SPEC.schema().fieldNames()
    assert clean.dtypes == [(f.name, f.dataType.simpleString()) for f in SPEC.schema().fields]


def test_rejected_lines_are_kept_whole(spark, raw):
    lines = delimited.read_lines(spark, [raw])
    rows = delimited.rejects(lines, 3, "\t").collect()
    assert [(r["raw_line"], r["field_count"], r["expected_count"], r["error_type"]) for r in rows] == [
        ("b\t2", 2, 3, "MISSING COLUMNS"),
        ("d\t1\t2\t3", 4, 3, "TOO MANY COLUMNS"),
    ]


@pytest.mark.parametrize("delimiter", [",", "|", "\t"])
def test_any_delimiter_and_several_files(spark, tmp_path, delimiter):
    paths = []
    for name in ("one", "two"):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"{name}{delimiter}1\n{name}\n")
        paths.append(str(path))
    lines = delimited.read_lines(spark, paths)
    assert sorted(r["x"] for r in delimited.parse(lines, ["x", "y"], delimiter).collect()) == ["one", "two"]
    assert delimited.rejects(lines, 2, delimiter).count() == 2


def test_one_pass_gives_the_same_rows(spark, raw, tmp_path):
    lines = delimited.read_lines(spark, [raw])
    path = str(tmp_path / "out")
    storage.write_parquet(delimited.sorted_out(lines, SPEC), path, ("rejected",))
    stored = spark.read.parquet(path)
    clean, rejects = delimited.clean_table(lines, SPEC)
    good = stored.filter("rejected = 0").select(clean.columns)
    bad = stored.filter("rejected = 1").select(rejects.columns)
    assert sorted(good.collect(), key=str) == sorted(clean.collect(), key=str)
    assert sorted(bad.collect(), key=str) == sorted(rejects.collect(), key=str)
    non_empty = sum(1 for line in LINES.split("\n") if line)
    assert stored.count() == non_empty


def test_lines_that_are_not_utf8_are_rejected(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_bytes(b"a\t1\tx\nb\t\xff\xfe\ty\r\nc\t2\n\xc3(\t1\t2\nd\t\xc3\xa9\tz\n")
    lines = delimited.read_lines(spark, [str(path)])
    good = delimited.parse(lines, list("abc"), "\t").collect()
    assert [tuple(row)[:3] for row in good] == [("a", "1", "x"), ("d", "é", "z")]
    bad = delimited.rejects(lines, 3, "\t").collect()
    kinds = [(row["field_count"], row["error_type"]) for row in bad]
    assert kinds == [(3, "INVALID ENCODING"), (2, "MISSING COLUMNS"), (3, "INVALID ENCODING")]
    stored = delimited.sorted_out(lines, SPEC).filter("rejected = 1").collect()
    assert [(row["field_count"], row["error_type"]) for row in stored] == kinds
    assert [row["raw_line"] for row in stored] == [row["raw_line"] for row in bad]


def test_missing_inputs_are_all_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="(?s)one.*two"):
        storage.require_paths(spark, [f"{tmp_path}/one", str(tmp_path), f"{tmp_path}/two"])
    assert storage.raw_directory(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "raw").mkdir()
    assert storage.raw_directory(spark, str(tmp_path)) == f"{tmp_path}/raw"


def test_materialise_builds_only_what_is_absent(spark, tmp_path):
    path = f"{tmp_path}/table"

    def rows(n, force=False):
        return storage.materialise(spark, path, lambda: spark.range(n), force).count()

    assert rows(3) == 3
    assert rows(5) == 3
    assert rows(5, force=True) == 5
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert rows(2) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_reports_are_one_file_with_a_header(spark, tmp_path):
    import csv

    rows = spark.createDataFrame([(2, 'a "q", b', [1, 2]), (1, None, [])], "n int, t string, q array<int>")
    for name, frame in {"full": rows.orderBy("n"), "empty": rows.filter("n > 5").orderBy("n")}.items():
        path = tmp_path / name
        storage.write_report(frame, str(path))
        files = list(path.glob("*.csv"))
        assert len(files) == 1
        with files[0].open(newline="") as handle:
            found = list(csv.reader(handle))
        assert found[0] == ["n", "t", "q"]
        if name == "full":
            assert found[1:] == [["1", "", "[]"], ["2", 'a "q", b', "[1,2]"]]


def test_scratch_lies_in_the_folder_of_the_session(spark):
    table = storage.scratch_table(spark.range(4), "numbers")
    assert table.count() == 4
    assert all(storage.scratch_folder(spark) in file for file in table.inputFiles())


def test_rejected_lines_have_their_number_in_files_of_several_splits(spark, tmp_path):
    """Splits of 600 bytes, some of one file in one task, small files together in others."""
    wanted = set()
    for name, count in (("one", 400), ("two", 3), ("three", 90), ("four", 0), ("five", 1)):
        lines = []
        for number in range(1, count + 1):
            line = "" if number % 7 == 0 else "x\t" * (number % 5) + "y" * (number % 40)
            if line and line.count("\t") != 2:
                wanted.add((name, number, line))
            lines.append(line)
        end = "" if name == "two" else "\n"
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + (end if lines else ""))
    settings = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "50"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = delimited.read_lines(spark, [str(tmp_path)], numbered=True)
        assert lines.select("source_file", "split").distinct().count() > 10
        found = delimited.rejects(lines, 3, "\t").collect()
        many = delimited.rejects(lines.unionAll(lines.limit(0)), 3, "\t")
        assert reject_count(many).first()[0] == len(wanted)
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert {(r["source_file"].rsplit("/", 1)[1][:-4], r["line"], r["raw_line"]) for r in found} == wanted
    assert len(found) == len(wanted)
