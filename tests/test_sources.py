import pytest
from pyspark.sql import functions as F

from filingloom.operators.drift import yearly_profiles
from filingloom.schemas import CORPUS
from filingloom.sources import (
    extract_filings,
    flat_name,
    read_filings,
    read_flat,
    tree_name,
    write_files,
    write_results,
)

LONG_A = "alpha risk " * 12
LONG_B = "beta risk " * 12


def submission(root, path, data):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("filings")
    period = "CONFORMED PERIOD OF REPORT:\t20231231\n"
    submission(
        root,
        "AAA/10-K/a1/full-submission.txt",
        period.replace("\n", "\r\n")
        + "Item 1A. Risk Factors\r\n<p class='x'>" + LONG_A + "</p>&#160;one&NBSP;two   three\r\n"
        + " \r\n\r\n" + LONG_B + "\r\nItem 1B. Unresolved\r\nrest",
    )
    submission(root, "AAA/10-K/a2/full-submission.txt", period + "ITEM 1A RISK FACTORS second Item 2.")
    submission(
        root, "BBB/10-K/b1/full-submission.txt", period + "Item 1A Risk Factors to the end\n\n"
    )
    submission(root, "CCC/10-K/c1/full-submission.txt", period + "Item 7. nothing here")
    submission(root, "DDD/10-K/d1/full-submission.txt", "Item 1A. Risk Factors x Item 1B")
    submission(root, "EEE/10-Q/e1/full-submission.txt", period + "Item 1A. Risk Factors x Item 1B")
    submission(root, "FFF/10-K/f1/other.txt", period + "Item 1A. Risk Factors x Item 1B")
    submission(
        root,
        "GGG/10-K/g1/full-submission.txt",
        period.encode() + b"Item\xc2\xa01A. Risk Factors ab\xff\xfecd Item 2.",
    )
    submission(root, "HHH/10-K/h1/full-submission.txt", period + "Item 1A. Risk FactorsItem 1B")
    return root


def by_ticker(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.ticker, []).append(row)
    return out


def test_filing_tree(spark, tree):
    df = read_filings(spark, str(tree))
    assert df.drop("source_path").schema.simpleString() == CORPUS.simpleString()
    rows = by_ticker(df)
    assert set(rows) == {"AAA", "BBB", "GGG", "HHH"}
    texts = sorted(r.text for r in rows["AAA"])
    first = LONG_A.strip() + " " + "one two three\n\n" + LONG_B.strip()
    assert texts == sorted([first, "second"])
    assert {r.year for r in rows["AAA"]} == {2023}
    assert [r.word_count for r in rows["AAA"] if r.text == first] == [24 + 3 + 24]
    assert rows["BBB"][0].text == "to the end"
    assert rows["GGG"][0].text == "abcd"
    assert (rows["HHH"][0].text, rows["HHH"][0].word_count) == ("", 0)
    assert len({r.doc_id for rs in rows.values() for r in rs}) == 5


def test_longest_section_skips_contents_line(spark):
    text = (
        "CONFORMED PERIOD OF REPORT: 20230101 Item 1A. Risk Factors 9 Item 1B. 10 "
        "Item 1A. Risk Factors the real text Item 2."
    )
    raw = spark.createDataFrame([("file:/x/T/10-K/a/full-submission.txt", text)], "path string, value string")
    assert extract_filings(raw).first().text == "9"
    assert extract_filings(raw, pick="longest").first().text == "the real text"
    with pytest.raises(ValueError):
        extract_filings(raw, pick="last")


def test_missing_folder_and_empty_folder(spark, tmp_path):
    for reader in (read_filings, read_flat):
        for path in (tmp_path / "nowhere", tmp_path):
            df = reader(spark, str(path))
            assert df.drop("source_path").schema.simpleString() == CORPUS.simpleString()
            assert df.count() == 0


def test_flat_files(spark, tmp_path):
    (tmp_path / "HHH_2023_risk_factors.txt").write_text("Item 1A stays\r\nhere")
    (tmp_path / "HHH_risk_factors.txt").write_text("malformed")
    (tmp_path / "III.txt").write_text("malformed")
    (tmp_path / "JJJ_2024.csv").write_text("other kind")
    rows = read_flat(spark, str(tmp_path)).collect()
    assert [(r.ticker, r.year, r.text, r.word_count) for r in rows] == [
        ("HHH", 2023, "Item 1A stays\nhere", 4)
    ]


def test_results_replace_and_split_by_year(spark, tmp_path):
    table = spark.createDataFrame([(2023, "a"), (2024, "b")], "year int, x string")
    out = str(tmp_path / "out")
    write_results({"t": table, "u": table.select("x")}, out)
    write_results({"t": table.where("year = 2024")}, out)
    assert [tuple(r) for r in spark.read.parquet(f"{out}/t").select("x", "year").collect()] == [("b", 2024)]
    assert (tmp_path / "out" / "t" / "year=2024").exists()
    assert spark.read.parquet(f"{out}/u").count() == 2


def test_paths_are_decoded_and_order_filings(spark, tmp_path):
    period = "CONFORMED PERIOD OF REPORT:\t20231231\n"
    for ticker in ("BRK B", "A+B", "C%D", "E%20F"):
        for n, words in (("a2", "late words here now"), ("a1", "first")):
            submission(tmp_path, f"{ticker}/10-K/{n}/full-submission.txt", period + f"Item 1A. Risk Factors {words} Item 2.")
            later = period.replace("2023", "2024")
            submission(tmp_path, f"{ticker}/10-K/b{n}/full-submission.txt", later + f"Item 1A. Risk Factors {words} Item 2.")
    found = read_filings(spark, str(tmp_path))
    assert {r.ticker for r in found.collect()} == {"BRK B", "A+B", "C%D", "E%20F"}
    theta = F.array(F.col("word_count").cast("double"))
    first = yearly_profiles(found.withColumn("theta", theta), 2023, 2024)
    assert {(r.ticker, *r.before, *r.after) for r in first.collect()} == {
        (t, 1.0, 1.0) for t in ("BRK B", "A+B", "C%D", "E%20F")
    }


def test_written_trees_and_flat_files_are_read_back(spark, tmp_path):
    text = "CONFORMED PERIOD OF REPORT:\t20231231\nItem 1A. Risk Factors\nunsafe é\nItem 1B."
    rows = [("AA", 2023, "x1", text), ("B&C+1", 2024, "x 2", text.replace("2023", "2024")), ("DD", 2023, "x3", None)]
    table = spark.createDataFrame(rows, "ticker string, year int, accession string, value string")
    tree = table.select(tree_name("ticker", "accession").alias("name"), "value")
    for _ in range(2):  # a repeated write replaces whole files
        written = {r.path: r.bytes for r in write_files(tree, f"{tmp_path}/tree").collect()}
    assert len(written) == 3 and sorted(written.values())[0] == 0
    found = sorted((r.ticker, r.year, r.text) for r in read_filings(spark, f"{tmp_path}/tree").collect())
    assert [(t, y) for t, y, _ in found] == [("AA", 2023), ("B&C+1", 2024)]
    assert all("unsafe é" in x for _, _, x in found)
    assert not [f for f in (tmp_path / "tree").rglob("*") if f.name.startswith("_")]

    flat = table.where("ticker <> 'DD'").select(flat_name("ticker", "year").alias("name"), "value")
    write_files(flat, f"file://{tmp_path}/flat").collect()
    assert sorted((r.ticker, r.year) for r in read_flat(spark, f"{tmp_path}/flat").collect()) == [("AA", 2023), ("B&C+1", 2024)]
    assert write_files(flat.where("false"), f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["../up.txt", "a//b.txt", "", None])
def test_files_are_written_below_their_root_only(spark, tmp_path, name):
    files = spark.createDataFrame([(name, "x")], "name string, value string")
    with pytest.raises(Exception, match="not a relative path"):
        write_files(files, str(tmp_path)).collect()


def test_trees_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver's file index, one entry a file in its memory, is not asked for."""
    period = "CONFORMED PERIOD OF REPORT:\t20231231\n"
    for n in range(30):
        submission(tmp_path, f"T{n % 3}/10-K/a{n}/full-submission.txt", period + "Item 1A. Risk Factors x Item 2.")
        submission(tmp_path, f"T{n % 3}/10-K/a{n}/other.txt", period + "Item 1A. Risk Factors x Item 2.")
    submission(tmp_path, "T0/10-K/_gone/full-submission.txt", period + "Item 1A. Risk Factors x Item 2.")
    submission(tmp_path, "T0/10-K/none/full-submission.txt", "")
    expected = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "full-submission.txt")
    paths = {r.p for r in expected.text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_path AS p").collect()}

    def refused(*_, **__):
        raise AssertionError("listed by the driver")

    monkeypatch.setattr(type(spark.read), "text", refused)
    found = {r.source_path for r in read_filings(spark, str(tmp_path)).collect()}
    assert len(found) == 30 and found == paths
