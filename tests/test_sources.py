"""Sources and sinks (S1, S4-S13) and the feature-name builders."""

import os

from pyspark.sql.types import LongType, StringType, StructField, StructType

from reelforge.functions import names as NM
from reelforge.sources import files as S
from reelforge.sources import tables as TB


def test_binary_file_catalog_prunes(spark, scratch):
    root = os.path.join(scratch, "media")
    for rel in ["a/song1.mid", "a/._song1.mid", "lmd_matched/x.mid", "b/c/song2.mid", "b/.DS_Store"]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write("x")
    cat = S.file_catalog(spark, root, except_dir=["lmd_matched"], except_file=r"\._|\.DS_Store")
    got = sorted((os.path.relpath(r.directory, root), r.filename) for r in cat.collect())
    assert got == [("a", "song1.mid"), ("b/c", "song2.mid")]


def test_csv_bom_header_roundtrip(spark, scratch):
    p = os.path.join(scratch, "cat.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("\ufeffdirectory,filename\n/m,a.mid\n/m,b.mid\n")
    df = TB.read_csv(spark, p)
    assert df.columns == ["directory", "filename"]
    assert df.count() == 2


def test_csv_write_append_custom_quote(spark, scratch):
    out = os.path.join(scratch, "out")
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "id long, name string")
    TB.write_csv(df, out, mode="overwrite", quote="|")
    TB.write_csv(df, out, mode="append", quote="|")
    back = spark.read.option("header", True).option("quote", "|").csv(out)
    assert back.count() == 4
    assert sorted(r.name for r in back.collect()) == ["a,b", "a,b", "c", "c"]


def test_table_sink_append_and_replace(spark, scratch):
    out = os.path.join(scratch, "t")
    df = spark.range(5)
    TB.write_table(df, out, "append")
    TB.write_table(df, out, "append")
    assert spark.read.parquet(out).count() == 10
    TB.write_table(df, out, "overwrite")
    assert spark.read.parquet(out).count() == 5


def test_ensure_table(spark, scratch):
    schema = StructType([StructField("id", LongType()), StructField("title", StringType())])
    name = "rf_test_catalog"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert TB.ensure_table(spark, name, schema, os.path.join(scratch, "tbl")) is True
    assert TB.ensure_table(spark, name, schema) is False
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_feature_lines_format(spark):
    df = spark.createDataFrame([("/x/y/clip.npy", [0.5, 1.0])], "name string, v array<double>")
    assert TB.feature_lines(df, "name", "v").collect()[0].line == "clip.npy\t0.500000\t1.000000\t"


def test_name_builders():
    assert len(NM.audio_feature_names()) == 138
    assert NM.audio_feature_names()[34] == "delta zcr_mean"
    frame, stats = NM.visual_feature_names(3, 1)
    assert len(stats) == 244
    assert len(NM.visual_feature_names(1)[1]) == 4 * 46
    assert len(NM.symbolic_feature_names()) == 73
    assert len(NM.symbolic_feature_names(drop="LanguageFeature")) == 72


def test_chunk_name_parse(spark):
    df = spark.createDataFrame([("vid_chunk__5000__10000.wav",), ("other.txt",)], "n string")
    s, e = S.chunk_bounds("n")
    rows = df.select(s.alias("s"), e.alias("e")).collect()
    assert (rows[0].s, rows[0].e) == (5000, 10000)
    assert rows[1].s is None


def test_named_extractor(spark):
    from reelforge.operators.extract import extract_with
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0)], "item_id long, x double")
    got = {r.item_id: (r.n, r.energy) for r in extract_with(df, "item_id", "sample_energy").collect()}
    assert got == {1: (2, 5.0), 2: (1, 4.0)}
