import pytest

from talkmill.plans import model_queries
from talkmill.plans.models import BASELINES, LEGACY


@pytest.mark.parametrize(
    "name",
    ["logistic_regression", "linear_svm", "keyword_svm", "calibrated_svm", "decision_tree"],
)
def test_settings_of_the_catalogue(name, monkeypatch):
    monkeypatch.setattr(model_queries, "_scores", lambda spark, sf_dir, label, spec, **options: (spec, options))
    spec, options = getattr(model_queries, name)(None, "")
    assert spec in [*BASELINES.values(), *LEGACY.values()] and not options


def test_neighbours_have_the_defaults(monkeypatch):
    monkeypatch.setattr(model_queries, "_parts", lambda spark, sf_dir: (None, None))
    monkeypatch.setattr(model_queries, "round6", lambda rows: rows)
    monkeypatch.setattr(model_queries.train, "knn_predictions", lambda fit, test, k, **options: (k, options))
    assert model_queries.knn_text(None, "") == (5, {})
