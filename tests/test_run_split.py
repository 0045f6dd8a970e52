"""Test rows don't move what is fitted on train."""

from pyspark.sql import functions as F

from sample_tables import SF


def test_medians_come_from_train(spark):
    from relyframe.operators.encode import Preprocessor
    from relyframe.plans.frame import raw_frame
    from relyframe.plans.pipeline import CleanConfig, clean_stage, prepare_stage
    from relyframe.plans.run import RunConfig
    cfg = RunConfig().clean
    assert cfg.fill_before_split is False and CleanConfig().fill_before_split is True
    prepared = prepare_stage(clean_stage(raw_frame(spark, SF), cfg), cfg).persist()
    assert prepared.where(F.col("area_dirty").isNull()).count() > 0
    test = F.col("row_id") % 5 == 0
    moved = prepared.withColumn("area_dirty", F.when(test, F.col("area_dirty") * 1000 + 7).otherwise(F.col("area_dirty")))
    one, two = (Preprocessor().fit(d.where(~test), ["area_dirty"]).transform(d.where(~test), keep=["row_id"]) for d in (prepared, moved))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.where(F.col("num__area_dirty").isNull()).count() == 0
    filled = prepare_stage(clean_stage(raw_frame(spark, SF), CleanConfig()), CleanConfig())
    assert filled.where(F.col("area_dirty").isNull()).count() == 0
