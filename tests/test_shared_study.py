"""Several drivers on one study: no trial twice, rungs judged by all, results and models kept."""

import threading

import pytest

from genolith import cli
from genolith.plans import tuning as tn


def test_two_drivers_share_a_study(spark, tmp_path):
    path = str(tmp_path / "study")
    space = {"x": (0, 50), "rate": (0.01, 1.0, "log"), "kind": ["a", "b"]}
    tn.SharedStudy.create(spark, path, space, seed=3, least=2, factor=2, note="n")
    again = tn.SharedStudy.create(spark, path, {"other": [1]}, seed=9)
    assert again.about["seed"] == 3 and again.about["note"] == "n" and set(again.params(0)) == set(space)
    assert again.params(4) == tn.SharedStudy(spark, path).params(4) != again.params(5)

    def train(params, heard, model):
        if params["x"] % 10 == 3:
            raise ValueError("odd settings")
        for epoch in range(4):
            heard(epoch, params["x"] * (1 + epoch))
        open(f"{tmp_path}/model-{model.rsplit('/', 1)[1]}", "w").close()
        return params["x"]

    ran: list[list[int]] = [[], []]
    drivers = [threading.Thread(target=lambda i=i: ran[i].extend(tn.SharedStudy(spark, path).run(train, 16))) for i in range(2)]
    for d in drivers:
        d.start()
    for d in drivers:
        d.join()
    assert sorted(ran[0] + ran[1]) == list(range(16))
    study = again.study()
    assert [t.number for t in study.trials] == list(range(16)) and all(t.params == again.params(t.number) for t in study.trials)
    for t in study.trials:
        assert t.state.startswith("failed") == (t.params["x"] % 10 == 3)
        assert (tmp_path / f"model-{t.number}").exists() == (t.state == "complete")
    assert any(t.state == "pruned" and max(t.scores) in (1, 3) for t in study.trials)
    best = study.best()
    assert best.params["x"] == max(t.params["x"] for t in study.trials if t.state == "complete")
    assert again.run(train, 16) == [] and again.retrain(train, f"{path}/models/99") == best.params["x"]
    # a claim without a result: its driver was lost, the study goes on with the next number
    again._write("claims/16", "")
    assert again.run(train, 18) == [17] and again.study().trials[16].state == "running"
    lines = [x.split("\t") for x in cli.run(spark, ["study-summary", path])]
    assert len(lines) == 18 and [x for x in lines if x[0] == str(best.number)][0][-1] == "complete"


def test_studies_of_topography_models(spark, tmp_path):
    cli.run(spark, ["study-create", str(tmp_path / "s"), "/nowhere", "--min-components", "2", "--max-components", "3", "--epochs", "1"])
    study = tn.SharedStudy(spark, str(tmp_path / "s"))
    assert study.about["train"] == "/nowhere" and study.params(0)["components"] in (2, 3) and study.params(0)["locus_model"] == "linear"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cli.run(spark, ["study-run", str(tmp_path / "s"), "--trials", "1"])
    assert study.study().trials[0].state == "running"
