"""Delimited and JSON files against Python's own readers."""

import csv
import hashlib
import io
import json
import random

import pytest

from tablewright.sources import delimited, files


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())
    return str(folder)


def made(seed, names, n=300):
    """A table with line ends, quotes and separators in its cells, as text with or without needless quotes."""
    r = random.Random(seed)
    bits = ["a", "b c", ",", '"', '""', "\n", "\n\n", "x" * 50, "é", " ", "12"]
    rows = [[str(i), *["".join(r.choice(bits) for _ in range(r.randint(1, 5))) + "." for _ in names[1:]]] for i in range(n)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow(names)
    w.writerows(rows)
    return out.getvalue(), [dict(zip(names, row)) for row in rows]


@pytest.mark.parametrize("split", ["134217728", "700"])
def test_cells_with_line_ends(spark, tmp_path, split):
    """Files of different column orders, cut into many small splits, also in the middle of cells."""
    want = []
    for k, names in enumerate((["id", "one", "two"], ["id", "two", "extra", "one"], ["id", "one", "two"])):
        text, rows = made(k, names)
        folder = put(tmp_path / "t", f"{k}.csv", text)
        want += [(r["id"], r["one"], r["two"]) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [tuple(r) for r in delimited.read_by_header(spark, folder, ["id", "one", "two"]).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(want)


def test_header_by_name(spark, tmp_path):
    folder = put(tmp_path / "t", "a.csv", "b,a\n1,2\n")
    for multiline in (False, True):
        assert [tuple(r) for r in files.read_delimited(spark, folder, ["a", "b"], multiline=multiline).collect()] == [("2", "1")]
        with pytest.raises(ValueError):
            files.read_delimited(spark, folder, ["a", "c"], multiline=multiline)
    put(tmp_path / "t", "b.csv", "a,b\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):  # never a silent swap
        files.read_delimited(spark, folder, ["a", "b"]).collect()
    assert sorted(tuple(r) for r in files.read_delimited(spark, folder, ["a", "b"], multiline=True).collect()) == [("2", "1"), ("3", "4")]


def test_quotes_inside_plain_cells(spark, tmp_path):
    """A quote that does not begin a cell opens nothing; blank lines are no records."""
    folder = put(tmp_path / "t", "a.csv", 'id,v\n1,5" pipe\n\n2,"x\ny"\n3,7" and 8"\n')
    assert sorted(tuple(r) for r in delimited.read_by_header(spark, folder, ["id", "v"]).collect()) == [("1", '5" pipe'), ("2", "x\ny"), ("3", '7" and 8"')]


def first_rows(payload):
    """The records that a JSON document stands for."""
    if isinstance(payload, list):
        return payload if payload and all(isinstance(x, dict) for x in payload) else []
    if not payload:
        return []
    if all(not isinstance(v, (list, dict)) for v in payload.values()):
        return [payload]
    return next((v for v in payload.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)), [])


@pytest.mark.parametrize("schema", ["k bigint, s string", None])
def test_json_documents(spark, tmp_path, schema):
    docs = [{"zeta": [{"k": 1, "s": "a[\n"}], "alpha": [{"k": 2}]}, {"a": [], "b": [1, 2], "c": [{"k": 3, "s": "}"}, {"s": "x"}], "d": {"k": 9}}, {"k": 4, "s": None}, [{"k": 5}, {"k": 6, "s": "ü"}],
            [], {}, [1, 2], {"d": {"k": 1}}, {"m": [{"k": 7}, 3], "n": [{"k": 8}]}]
    for i, d in enumerate(docs):
        folder = put(tmp_path / "j", f"{i}.json", ("\n " if i % 2 else "") + json.dumps(d, indent=i % 3 or None))
    want = sorted(repr((r.get("k"), r.get("s"))) for d in docs for r in first_rows(d))
    assert sorted(repr((r.k, r.s)) for r in files.read_json_table(spark, folder, schema).collect()) == want


def test_file_facts_beyond_two_gigabytes(spark, tmp_path):
    """A file that no single value can hold (sparse), beside small ones with odd names."""
    names = {"a b%20c#.bin": b"\xef\xbb\xbfx\r\n\x00", "t.csv.gz": b"not packed"}
    for name, body in names.items():
        (tmp_path / name).write_bytes(body)
    with open(tmp_path / "large", "wb") as f:
        f.truncate(2**31 + 5)
        f.seek(2**31 + 1)
        f.write(b"end")
    want = {}
    for p in tmp_path.iterdir():
        with open(p, "rb") as f:
            want[f"file:{p}"] = (p.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest())
    got = files.file_facts(spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 3
    assert {r.path: (r.size_bytes, r.fingerprint) for r in got} == want
    only = files.file_facts(spark, [str(tmp_path / "large"), str(tmp_path / "t*.gz")])
    assert {r.path for r in only.select("path").collect()} == {f"file:{tmp_path}/large", f"file:{tmp_path}/t.csv.gz"}


def test_file_facts_of_another_store(spark, tmp_path, monkeypatch):
    """Files that Python cannot open: small ones by tasks, those above the limit by the driver, none left out or twice."""
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000)
    spark.conf.set("fs.viewfs.mounttable.facts.link./in", f"file://{tmp_path}")
    for name, n in (("a", 1), ("b c%20", 1000), ("d", 1001), ("e f%20.gz", 300_000)):
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    got = files.file_facts(spark, "viewfs://facts/in").collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (f"viewfs://facts/in/{p.name}", p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir())
    assert files.file_facts(spark, "viewfs://facts/in/a").columns == ["path", "size_bytes", "fingerprint"]
