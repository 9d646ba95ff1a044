import csv
import io
import random

import pytest

from marketlens.sources import bronze, csv_records, schemas

NAMES = schemas.columns("order_reviews")
HEADER = ",".join(NAMES)


def plain_open(text):
    """Whether quotes are open at the end of a text, character by character."""
    quoted, field_begins, i = False, True, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"':
                if text[i + 1:i + 2] == '"':
                    i += 1
                else:
                    quoted = False
        elif c == '"' and field_begins:
            quoted = True
        field_begins = not quoted and c in ",\n"
        i += 1
    return quoted


def test_state_after_a_line():
    rng = random.Random(4)
    for _ in range(20_000):
        line = "".join(rng.choices('",ab', k=rng.randint(0, 9)))
        assert csv_records.after(line, False) == plain_open(line), line
        assert csv_records.after(line, True) == plain_open('"' + line), line


def write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return str(path)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, str(n) if "max" in k else v) for k, v in keys.items()]
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_text(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def test_a_quoted_break_at_each_split(spark, tmp_path, small_splits):
    """The same file is read with the split's end at every place around a quoted break."""
    rows = [["r1", "o1", "5", "plain", "text", "a", "b"], ["r2", "o2", "4", "t", 'one\n"two",\n\nthree\n', "a", "b"],
            ["r3", "o3", "", "", ",\n", "a", "b"], ["r4", "o4", "1", "5\" pipe", "x", "", "z"]]
    path = write(tmp_path / "f.csv", HEADER + "\n" + rows_text(rows))
    for n in [*range(HEADER.__len__() - 2, HEADER.__len__() + 50, 3), 7, 1000]:
        small_splits(n)
        got = bronze.ingest_csv(spark, {"order_reviews": path})["order_reviews"]
        assert sorted([x or "" for x in r] for r in got.rows.collect()) == sorted(rows), n
        assert got.rejects.count() == 0


@pytest.mark.parametrize("size", [40, 97, 1 << 20])
def test_random_files_like_the_csv_module(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    small_splits(size)
    folder, want = tmp_path / "f", []
    folder.mkdir()
    for i in range(3):
        rows = [["".join(rng.choices(['a', ' ', ',', '"', '\n', 'é', '\r\n'], k=rng.randint(0, 12))) for _ in NAMES] for _ in range(30)]
        rows = [["x" + r[0], *r[1:-1], r[-1] + "y"] for r in rows]
        write(folder / f"{i}.csv", HEADER + "\n" + rows_text(rows))
        want += rows
    got = bronze.ingest_csv(spark, {"order_reviews": str(folder)})["order_reviews"]
    assert sorted([x or "" for x in r] for r in got.rows.collect()) == sorted(want) and got.rejects.count() == 0


def test_rejects_and_stray_quotes(spark, tmp_path):
    good = 'r1,o1,5,t,m,a,b'
    text = f'﻿{HEADER}\r\n{good}\r\n\r\nr2,too few\r\nr3,o3,5,5" pipe,m,a,b\r\nr4,o4,1,t,m,a,b,c\r\n"r5",o5,2,"never closed\r\n{good}\r\n'
    got = bronze.ingest_csv(spark, {"order_reviews": write(tmp_path / "f.csv", text)})["order_reviews"]
    assert sorted((r.review_id, r.review_comment_title) for r in got.rows.collect()) == [("r1", "t"), ("r3", '5" pipe')]
    rejects = sorted((r.reason, r.raw_record) for r in got.rejects.collect())
    assert [r for r, _ in rejects] == ["number of fields", "number of fields", "open quote"]
    assert rejects[0][1] == "r2,too few" and rejects[2][1].startswith('"r5"')
    sellers = bronze.ingest_csv(spark, {"sellers": write(tmp_path / "s.csv", "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,a,b\ns2,1\n")})["sellers"]
    assert [r.seller_id for r in sellers.rows.collect()] == ["s1"] and [r.raw_record for r in sellers.rejects.collect()] == ["s2,1"]


def test_another_header_is_an_error(spark, tmp_path):
    path = write(tmp_path / "f.csv", ",".join(reversed(NAMES)) + "\nr1,o1,5,t,m,a,b\n")
    with pytest.raises(Exception, match="the header of order_reviews"):
        bronze.read_csv(spark, {"order_reviews": path})["order_reviews"].collect()


def test_empty_files(spark, tmp_path):
    path = write(tmp_path / "f.csv", HEADER + "\n")
    got = bronze.ingest_csv(spark, {"order_reviews": path})["order_reviews"]
    assert got.rows.count() == 0 and got.rejects.count() == 0


def test_each_record_is_parsed_once(spark, tmp_path):
    from marketlens.operators import cleaning
    path = write(tmp_path / "f.csv", ",".join(schemas.columns("order_items")) + "\no1,1,p1,s1,2017-01-01,5.00,1.00\no1,x,p1,s1,2017-01-01,5.00,1.00\n")
    df = cleaning.clean_table("order_items", bronze.read_csv(spark, {"order_items": path})["order_items"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    assert [(r.order_id, r.order_item_id) for r in df.collect()] == [("o1", 1)]


def test_counts_read_a_file_once(spark, tmp_path, monkeypatch):
    from marketlens.plans import q_ingest
    path = write(tmp_path / "s.csv", ",".join(schemas.columns("sellers")) + "\ns1,1,a,b\ns2,1\ns3,1,a,b\n")
    monkeypatch.setattr(q_ingest, "written", lambda spark, sf_dir: {"sellers": path})
    df = q_ingest.csv_ingest_counts(spark, "")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in df.collect()] == [("sellers", 2, 1)]


def test_headers_of_written_files(spark, tmp_path):
    """Headers are put in by Spark, one in each file that has records; a null record is an empty line."""
    lines = spark.range(0, 40, 1, 4).where("id < 10 or id >= 20").selectExpr("if(id = 30, null, concat('s', id, ',1,a,b')) as value")
    names = schemas.columns("sellers")
    bronze.write_csv(lines, names, str(tmp_path / "out"))
    files = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert [f.splitlines()[0] for f in files if f] == [",".join(names)] * 3
    assert sum(len(f.splitlines()) - 1 for f in files if f) == 30
    got = bronze.ingest_csv(spark, {"sellers": str(tmp_path / "out")})["sellers"]
    assert sorted(r.seller_id for r in got.rows.collect()) == sorted(f"s{i}" for i in [*range(10), *range(20, 40)] if i != 30)
    bronze.write_csv(lines.where("value = ''"), names, str(tmp_path / "none"))
    assert bronze.ingest_csv(spark, {"sellers": str(tmp_path / "none")})["sellers"].rows.count() == 0


def test_only_splits_with_open_quotes_are_read_for_fragments(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    pieces = csv_records.pieces

    def counted(batches):
        def counting():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        yield from pieces(counting())

    monkeypatch.setattr(csv_records, "pieces", counted)
    path = write(tmp_path / "f.csv", HEADER + "\n" + 'r1,o1,5,t,"one\ntwo",a,b\n' * 50)
    assert bronze.ingest_csv(spark, {"order_reviews": path})["order_reviews"].rows.count() == 50
    assert seen.value == 101


def test_trailing_carriage_returns(spark):
    texts = ["a", "a\r", "a\r\r", "a\rb", "\r", "", None, "a\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.selectExpr("t", "regexp_replace(t, '\\\\r$', '') as want").select(csv_records.without_return(df["t"]), "want").collect()
    assert [a for a, _ in got] == [b for _, b in got]
    assert got[1][0] == "a"
