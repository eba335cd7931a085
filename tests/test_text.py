"""Text sources and sinks."""

import pytest

from quadrille.sources.text import bad_lines, normalise_points, read_cell_counts, read_points, split_domain, write_points


def test_points_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.5, 0.25), (2, 0.125, 0.75)], "tid long, x double, y double")
    write_points(p, str(tmp_path / "p"), "tid", 2)
    assert sorted(read_points(spark, str(tmp_path / "p")).collect()) == sorted(p.collect())


def test_bad_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1\t0.5\t0.5\n2\t0.5\nx\t1\t2\n3\t0.1\t0.2\t0.3\t9\n")
    path = str(tmp_path / "f.txt")
    assert [r.tid for r in read_points(spark, path, on_bad="quarantine").collect()] == [1]
    assert bad_lines(spark, path).count() == 3
    with pytest.raises(Exception, match="not a point"):
        read_points(spark, path).collect()


def test_counts_and_domain(spark, tmp_path):
    (tmp_path / "part-0").write_text("012\t5\n")
    assert read_cell_counts(spark, str(tmp_path)).first().cell == "012"
    p = spark.createDataFrame([(1, 1.0, 0.0), (2, -0.1, 0.5), (3, 0.2, None), (4, 0.2, 0.2)], "tid long, x double, y double")
    inside, outside = split_domain(p, 2)
    assert inside.count() == 1 and outside.count() == 3
    assert split_domain(normalise_points(p.where("y is not null"), 2), 2)[1].count() == 0
