"""Matrix files: split plain files, gzip, symmetric and pattern matrices, dense tables with names beside them."""

import gzip

import pytest
from vicinage.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_lines_of_a_split_file_keep_their_numbers(spark, tmp_path, small_ranges):
    lines = [f"name {i * 7919 % 1000}" if i % 5 else "" for i in range(300)]
    (tmp_path / "plain.txt").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "packed.txt.gz", "wt") as out:
        out.write("\n".join(lines))
    assert spark.read.text(str(tmp_path / "plain.txt")).rdd.getNumPartitions() > 10
    for name in ("plain.txt", "packed.txt.gz"):
        assert rows(files.read_lines(spark, str(tmp_path / name), "name")) == list(enumerate(lines, 1))


def test_matrix_market_round_trip(spark, tmp_path, small_ranges):
    values = [(f"g{i * 37 % 20}", f"c{i}", i / 7) for i in range(1, 120)]
    df = spark.createDataFrame([*values, ("g1", None, 1.0), ("g1", "c1", None)], "gene string, cell_id string, value double")
    for codec in ("none", "gzip"):
        where = f"{tmp_path}/{codec}"
        files.write_matrix_market(df, where, compression=codec)
        assert rows(files.read_matrix_market(spark, f"{where}/matrix", f"{where}/rows", f"{where}/cols")) == sorted(values)
    lines = [r["value"] for r in files.numbered_lines(spark, f"{tmp_path}/none/matrix").orderBy("n").collect()]
    assert lines[:2] == ["%%MatrixMarket matrix coordinate real general", "20 119 119"] and len(lines) == 121


def test_symmetric_pattern_and_other_matrices(spark, tmp_path):
    def read(text):
        (tmp_path / "m.mtx").write_text(text)
        return rows(files.read_matrix_market(spark, str(tmp_path / "m.mtx")))

    assert read("%%MatrixMarket matrix coordinate real symmetric\n% note\n\n3 3 2\n1 1 4\n3 1 -2.5e0\n") == [(1, 1, 4.0), (1, 3, -2.5), (3, 1, -2.5)]
    assert read("%%MatrixMarket matrix coordinate integer skew-symmetric\n2 2 1\n2 1 3\n") == [(1, 2, -3.0), (2, 1, 3.0)]
    assert read("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n2 1\n2 1\n") == [(2, 1, 1.0), (2, 1, 1.0)]
    assert read("%%MatrixMarket matrix coordinate real general\n2 2 0\n") == []
    with pytest.raises(ValueError):
        read("%%MatrixMarket matrix array real general\n1 1\n1.0\n")


def test_dense_tables_with_names_beside_or_inside(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as out:
        out.write('"V1"\tV2\tV3\n1\t0\t2.5\n0\tNA\t-3\n')
    (tmp_path / "rows.txt").write_text("g a\ng b\n")
    (tmp_path / "cols.txt").write_text("c1\nc2\nc3\n")
    (tmp_path / "few.txt").write_text("c1\n")
    x, names, cols, few = (str(tmp_path / n) for n in ("x.tsv.gz", "rows.txt", "cols.txt", "few.txt"))
    assert sorted(map(str, files.read_dense(spark, x, names, cols).collect())) == sorted(map(str, spark.createDataFrame([("g a", "c1", 1.0), ("g a", "c3", 2.5), ("g b", "c2", None), ("g b", "c3", -3.0)], "gene string, cell_id string, value double").collect()))
    assert rows(files.read_dense(spark, x, cols=few).filter("value is not null")) == [("1", "V1", 1.0), ("1", "V3", 2.5), ("2", "V3", -3.0)]
    (tmp_path / "named.tsv").write_text("V1\tV2\nr1\t1\t2\nr2\t0\t4\n")
    assert rows(files.read_dense(spark, str(tmp_path / "named.tsv"), keep_zeros=True)) == [("r1", "V1", 1.0), ("r1", "V2", 2.0), ("r2", "V1", 0.0), ("r2", "V2", 4.0)]
