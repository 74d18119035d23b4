"""The report sink: what it writes, what a failed task leaves, and what is read back."""

import os

import pytest
from pyspark.sql import functions as F

from talkspan.sources import reports as O

SHAPE = "name string, n long, share double, good boolean"
ROWS = [("a|b", 1, 0.5, True), ("line\nbreak \\ back", None, 1e-7, False), (None, 3, None, None), ("50% & more_ #1 {x} ~ ^ $", -4, 2.0, True)]


def read(path):
    with open(path) as f:
        return f.read()


def test_markdown_and_latex(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SHAPE).coalesce(1)
    O.write_report(df, f"{tmp_path}/t.md", title="Things")
    assert read(f"{tmp_path}/t.md") == (
        "# Things\n\n| name | n | share | good |\n| --- | ---: | ---: | --- |\n"
        "| a\\|b | 1 | 0.5 | true |\n| line<br>break \\\\ back |  | 1e-07 | false |\n|  | 3 |  |  |\n| 50% & more_ #1 {x} ~ ^ $ | -4 | 2.0 | true |\n"
    )
    O.write_report(df, f"file://{tmp_path}/t.tex", "latex", title="All_things")
    lines = read(f"{tmp_path}/t.tex").splitlines()
    assert lines[:3] == ["\\begin{table}", "\\caption{All\\_things}", "\\begin{tabular}{lrrl}"] and lines[-2:] == ["\\end{tabular}", "\\end{table}"]
    assert lines[6] == "a|b & 1 & 0.5 & true \\\\" and "50\\% \\& more\\_ \\#1 \\{x\\} \\textasciitilde{} \\textasciicircum{} \\$ & -4" in lines[9]


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([('a "b"\\\n', 3.5), (None, 2.0), ("x", None)], "maxim string, total double").coalesce(1)
    O.write_report(df, f"{tmp_path}/m.prom", "metrics", prefix="hits-", type="counter", title="Hits")
    assert read(f"{tmp_path}/m.prom") == '# HELP hits_total Hits\n# TYPE hits_total counter\nhits_total{maxim="a \\"b\\"\\\\\\n"} 3.5\nhits_total{maxim=""} 2.0\n'
    O.write_report(df.select("total").limit(1), f"{tmp_path}/m.prom", "metrics")
    assert read(f"{tmp_path}/m.prom") == "# TYPE total gauge\ntotal 3.5\n"
    with pytest.raises(Exception, match="one numeric column"):
        O.write_report(df.withColumn("more", F.lit(1)), f"{tmp_path}/m.prom", "metrics")


def test_order_of_partitions_and_reading_back(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("r"), "id").alias("name"), (F.col("id") * 3).alias("n")).repartitionByRange(6, "n").sortWithinPartitions("n")
    O.write_report(df, f"{tmp_path}/t.md")
    back = O.read_markdown(spark, f"{tmp_path}/t.md", "name string, n long")
    assert sorted(map(tuple, back.collect())) == sorted((f"r{k}", 3 * k) for k in range(500))
    assert [line.split(" | ")[1].rstrip(" |\n") for line in read(f"{tmp_path}/t.md").splitlines()[2:]] == [str(3 * k) for k in range(500)]
    O.write_report(df.limit(0), f"{tmp_path}/t.md")
    assert read(f"{tmp_path}/t.md") == "| name | n |\n| --- | ---: |\n" and O.read_markdown(spark, f"{tmp_path}/t.md", "name string, n long").count() == 0
    assert os.listdir(tmp_path) == ["t.md"]  # no staging is left


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    good = spark.range(8).select("id")
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        O.write_report(bad, f"{tmp_path}/t.md")
    assert not os.path.exists(f"{tmp_path}/t.md")
    O.write_report(good, f"{tmp_path}/t.md")
    before = read(f"{tmp_path}/t.md")
    with pytest.raises(Exception, match="broken row"):
        O.write_report(bad, f"{tmp_path}/t.md")
    assert read(f"{tmp_path}/t.md") == before
    with pytest.raises(Exception, match="there already"):
        good.write.format("report").mode("append").save(f"{tmp_path}/t.md")
    assert read(f"{tmp_path}/t.md") == before
    with pytest.raises(Exception, match="unknown kind"):
        O.write_report(good, f"{tmp_path}/t.pdf", "pdf")
    assert os.listdir(tmp_path) == ["t.md"]
