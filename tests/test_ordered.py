import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions.ordered import exact_quantiles, hash_sample_exact, running

def spec():
    return {"pos": ("position", None), "cum": ("sum", F.col("v")), "seen": ("max_before", F.col("v")),
            "prev": ("previous", F.col("v")), "all": ("total", F.col("v"))}


def skewed(spark, n=4000):
    """One group holds 40 % of the rows, the NULL group 30 %; many rows share an order key."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 4, "hot").when(F.col("id") % 10 >= 7, F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        F.pmod(F.col("id") * 7919, F.lit(50)).alias("k"), "id",
        F.when(F.col("id") % 9 != 0, F.pmod(F.col("id") * 31, F.lit(101)).cast("double")).alias("v"))


@pytest.mark.parametrize("slabs", [1, 3, 16])
@pytest.mark.parametrize("group", [["g"], []])
def test_slabs_equal_the_plain_window(spark, slabs, group):
    df, order = skewed(spark), [F.col("k"), F.desc("id")]
    a = running(df, group, order, spec(), spread=False)
    b = running(df.repartition(7), group, order, spec(), spread=True, slabs=slabs).select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hot_group_is_cut(spark):
    from flowloom.functions.ordered import lay_out

    sizes = lay_out(skewed(spark), ["g"], [F.col("k"), F.col("id")], 8).groupBy("_slab").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4000 * 0.3


@pytest.mark.parametrize("spread", [False, True])
def test_quantiles_match_numpy(spark, spread):
    df = skewed(spark)
    qs = {"a": ("v", 0.01), "b": ("v", 0.5), "c": ("v", 0.99), "d": ("id", 0.25)}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], qs, spread=spread).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby(pdf["g"].astype(object).where(pdf["g"].notna(), None), dropna=False):
        g = None if g != g else g
        for name, (c, q) in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(part[c].dropna(), q))


@pytest.mark.parametrize("spread", [False, True])
def test_exact_share(spark, spread):
    df = skewed(spark)
    out = hash_sample_exact(df, ["g"], 0.25, [F.col("id")], 7, spread=spread)
    for r in out.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("held_out").cast("int")).alias("h")).collect():
        assert r["h"] == round(r["n"] * 0.25)


def test_checkpoint_folder_comes_from_the_session(spark):
    from flowloom.session import checkpoint_dir

    first = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == first == spark.sparkContext.getCheckpointDir()


def test_text_is_parsed_once(spark, tmp_path, monkeypatch):
    """Slab borders take a second pass: over stored columns, never over text files."""
    from flowloom.functions import ordered
    written = []
    made = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: written.append(df) or made(df))
    rows = spark.range(50).selectExpr("id", "id % 3 AS g")
    rows.write.parquet(f"{tmp_path}/p")
    rows.write.csv(f"{tmp_path}/c")
    ordered.lay_out(spark.read.parquet(f"{tmp_path}/p").where("id >= 0"), ["g"], [F.col("id")])
    assert len(written) == 1
    laid = ordered.lay_out(spark.read.schema("id long, g long").csv(f"{tmp_path}/c").where("id >= 0"), ["g"], [F.col("id")])
    assert len(written) == 3 and laid.count() == 50
