"""Driver contract: entry runs, every oracle key is registered."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query", "n_texts"]
    assert df.count() >= 0


def test_oracle_keys_are_registered():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    rows_only = {k for k in set(qs) - set(sqls) if k != "pipeline" and not k.startswith("op")}
    assert rows_only == {"vote_logit", "vote_discriminant", "vote_svm", "vote_nearest", "vote_tree", "vote_gboost",
                         "vote_forest", "vote_counts_several", "klr_keywords"}
