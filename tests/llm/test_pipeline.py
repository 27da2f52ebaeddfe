"""The corpus pipeline on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "quality_classifier":
            assert good <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_take_odd_rows(spark):
    from pyspark.sql import functions as F

    from flowloom.session import cut_lineage

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    columns = docs.columns
    first = docs.where("doc_id = 3")
    odd = docs.unionByName(first).unionByName(first.withColumn("text", F.reverse("text")))  # a repeated row, one id with two texts
    odd = odd.unionByName(docs.where("doc_id = 4").withColumns({"doc_id": F.lit(None).cast("bigint"), "lang": F.lit(None).cast("string")}))
    odd = odd.unionByName(docs.where("doc_id IN (5, 6)").withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.when(F.col("doc_id") == 5, "")}))
    # Other columns, named like helpers and results.
    names = ["_id", "_row", "_text", "_digest", "_first", "n_symbols", "kept", "found", "base", "kept_text", "length"]
    for name in names:
        odd = odd.withColumn(name, F.lit(name))
    odd = cut_lineage(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.columns == [*columns, *names], name
        odd = cut_lineage(odd)
    assert {r[n] for r in odd.collect() for n in names} == set(names)
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert packed.where("piece = 0").count() == odd.count()


def test_order_of_rare_characters_decides_quality(spark, tmp_path):
    """Junk of the characters of a good text, all of them outside the most frequent ones, is told by their order."""
    import random

    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(150)]
    follows = {c: r.sample(letters, 2) for c in letters}

    def write(n):
        out = [r.choice(letters)]
        while len(out) < n:
            out.append(r.choice(follows[out[-1]]))
        return "".join(out)

    common = "".join(chr(0x410 + i) for i in range(40)) * 2000  # takes all symbols of the class model
    good = [write(300) for _ in range(60)]
    junk = ["".join(r.choice(letters) for _ in range(300)) for _ in range(6)]
    rows = [(i, t, "zh", "s", len(t)) for i, t in enumerate(good + junk)] + [(100 + i, common[i:], "ru", "s", len(common) - i) for i in range(4)]
    spark.createDataFrame([(i, 1, 0) for i in [*range(50), 100, 101, 102, 103]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(60), 100, 101, 102, 103}
