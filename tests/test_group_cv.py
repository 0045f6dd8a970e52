"""group_cv makes its split once."""


def test_group_cv_splits_once(spark, monkeypatch):
    from sample_tables import SF
    from relyframe.plans import q_mcr, q_split
    from relyframe.plans.q_models import q_group_cv
    made, plain = [], q_split.split_frame
    for m in (q_mcr, q_split):
        monkeypatch.setattr(m, "split_frame", lambda *a: made.append(1) or plain(*a))
    assert q_group_cv(spark, SF).count() == 1
    assert len(made) == 1
