import random

from logfold.sources.lines import read_lines
from pyspark.sql import functions as F


def write(folder, name, lines, end="\n"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes("".join(line + end for line in lines).encode())


def in_order(df, device):
    return [r["value"] for r in df.filter(F.col("device") == device).orderBy("seq").collect()]


def test_order_over_many_splits(spark, tmp_path):
    rng = random.Random(0)
    want = {}
    for d in ("a b%c", "b"):
        for f in range(5):
            lines = [f"{d}-{f}-{i}-" + "x" * rng.randint(0, 60) for i in range(rng.choice([1, 40, 900]))]
            write(tmp_path / f"device={d.replace('%', '%25')}", f"log.{f}.txt", lines)
            want.setdefault(d, []).extend(lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        for d, lines in want.items():
            assert in_order(df, d) == lines
        assert df.select("device", "seq").distinct().count() == df.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folders_below_a_device(spark, tmp_path):
    want = []
    for day in (1, 2, 3):
        for name in ("a.txt", "b.txt"):
            lines = [f"{day}-{name}-{i}" for i in range(30)]
            write(tmp_path / "device=p" / f"day={day}", name, lines)
            want += lines
    df = read_lines(spark, str(tmp_path))
    assert in_order(df, "p") == want
    assert df.select("seq").distinct().count() == len(want)
    plain = read_lines(spark, str(tmp_path / "device=p"), device="q")
    assert in_order(plain, "q") == want


def test_framing(spark, tmp_path):
    write(tmp_path / "x", "a.txt", ["one\r", "two\r\r", "th\rree", "", " four"])
    df = read_lines(spark, str(tmp_path / "x"), device="phone")
    assert in_order(df, "phone") == ["one", "two\r", "th\rree", "", " four"]
