"""CSV records over many byte ranges against the reader of the standard library."""

import csv
import io

import pytest

from clickwarden.sources.csv_records import read_csv_records

HEADER = ["id", "path", "note"]


@pytest.fixture(params=[37, 100, 1 << 20])
def narrow(spark, request):
    """Byte ranges of that many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def _write(folder, name, rows, header=HEADER, line="\n"):
    text = io.StringIO()
    writer = csv.writer(text, lineterminator=line)
    writer.writerows([header, *rows])
    (folder / name).write_bytes(text.getvalue().encode())
    return text.getvalue()


def _read(spark, path):
    return sorted(tuple(r) for r in read_csv_records(spark, str(path)).collect())


def _rows(count, start=0):
    notes = ["plain", "two\nlines", 'a "quoted" word', 'long\n\n"text"\n' + "x" * 80 + "\n,end", "a, b", "tail\n"]
    return [(str(start + i), f"/p{i % 5}", notes[i % len(notes)]) for i in range(count)]


def test_line_feeds_in_quotes_over_many_ranges(spark, tmp_path, narrow):
    first, second = _rows(30), _rows(9, 100)
    _write(tmp_path, "a.csv", first)
    _write(tmp_path, "b.csv", second)
    assert _read(spark, tmp_path) == sorted(first + second)


def test_lines_without_quoted_feeds_and_other_line_ends(spark, tmp_path, narrow):
    rows = [(str(i), f"/p{i}", 'say "x"') for i in range(20)]
    _write(tmp_path, "a.csv", rows)
    assert _read(spark, tmp_path / "a.csv") == sorted(rows)
    rows.append(("99", "/q", "one\ntwo"))
    _write(tmp_path, "b.csv", rows, line="\r\n")
    assert _read(spark, tmp_path / "b.csv") == sorted(rows)


def test_odd_files(spark, tmp_path):
    _write(tmp_path, "header.csv", [("1", "/a", "x\ny")], header=["id", "path", "free\nnote"])
    assert _read(spark, tmp_path / "header.csv") == [("1", "/a", "x\ny")]
    _write(tmp_path, "empty.csv", [])
    assert _read(spark, tmp_path / "empty.csv") == []
    (tmp_path / "blank.csv").write_text('id,path,note\n\n1,/a,"x\ny"\n  \n2,/b,z\n')
    assert _read(spark, tmp_path / "blank.csv") == [("1", "/a", "x\ny"), ("2", "/b", "z")]
    (tmp_path / "open.csv").write_text('id,path,note\n1,/a,"x\n2,/b,z\n')
    with pytest.raises(Exception, match="ends within quotes"):
        _read(spark, tmp_path / "open.csv")
