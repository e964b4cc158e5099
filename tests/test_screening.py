from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from skerry.operators.screening import choose_strength, fit_screening, strongest, terms
from skerry.plans.learning import term_frequencies


def test_vocabulary_holds_every_term(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(50_100)), lambda x: F.concat(F.lit("t"), x.cast("string")))
    df = spark.range(8).select((F.col("id") % 2).cast("double").alias("label"), F.when(F.col("id") < 4, many).otherwise(F.array(F.lit("rare"))).alias("terms"))
    model = fit_screening(df, "label")
    assert set(model.counts.vocabulary) == {"rare", *(f"t{i}" for i in range(1, 50_101))}


def test_frequencies_count_abstracts(spark, tmp_path):
    rows = [(i, "salmon" if i else None, "lice" if i < 3 else None) for i in range(5)]
    spark.createDataFrame(rows, "record_sequence int, title string, abstract string").write.parquet(str(tmp_path / "clean_records.parquet"))
    assert {r.term: r.df for r in term_frequencies(spark, str(tmp_path)).collect()}["lice"] == 3


def test_strength_is_chosen_by_folds(spark):
    rows = [(i, f"{'lice bath' if i % 2 else 'market price'} word{i % 7} word{i % 5}", float(i % 2 if i % 9 else 1 - i % 2)) for i in range(120)]
    t = terms(spark.createDataFrame(rows, "g int, text string, label double"), "text")
    model = fit_screening(t, "label", strength=None, group="g", folds=3, steps=3)
    features = model.features(t)
    top = strongest(features, "label")
    chosen, tried = choose_strength(features, "label", "g", folds=3, steps=3)
    assert [s for s, _, _ in tried] == [top, top * 0.1, top * 0.01]
    least = min(tried, key=lambda x: x[1])
    assert chosen == max(s for s, m, _ in tried if m <= least[1] + least[2]) < top
    at_top = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=top * 1.001, standardization=False).fit(features)
    assert at_top.coefficients.numNonzeros() == 0 < model.model.coefficients.numNonzeros()
