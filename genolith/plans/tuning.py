"""Random search over model settings with successive halving; trials are kept as a table, or in a folder that several drivers share."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A trial is judged first after LEAST epochs, then each time that FACTOR times as many are done, and stays in the best 1 / FACTOR.
LEAST, FACTOR = 5, 3


class Pruned(Exception):
    """Raised inside a trial that falls behind."""


@dataclass
class Trial:
    number: int
    params: dict[str, Any]
    value: float | None = None
    state: str = "running"
    scores: dict[int, float] = field(default_factory=dict)


class Study:
    """Random search that maximises train(params, callback).

    train calls callback(epoch, score) after each epoch; at a rung the callback raises Pruned unless the score is among the best 1 / factor of the trials that
    got there (the first trial always goes on). space: name -> list of choices, (low, high) for whole numbers, or (low, high, "log") for floats.
    """

    def __init__(self, space: dict[str, Sequence], seed: int = 0, least: int = LEAST, factor: int = FACTOR):
        self.space, self.least, self.factor, self.trials = space, least, factor, []
        self._rng = np.random.default_rng(seed)

    def sample(self) -> dict[str, Any]:
        out = {}
        for name, choice in self.space.items():
            if isinstance(choice, tuple) and len(choice) == 3:
                out[name] = float(math.exp(self._rng.uniform(math.log(choice[0]), math.log(choice[1]))))
            elif isinstance(choice, tuple):
                out[name] = int(self._rng.integers(choice[0], choice[1] + 1))
            else:
                out[name] = choice[int(self._rng.integers(len(choice)))]
        return out

    def _rung(self, epoch: int) -> bool:
        n = epoch + 1
        while n > self.least and n % self.factor == 0:
            n //= self.factor
        return n == self.least

    def run(self, train: Callable[[dict[str, Any], Callable[[int, float], None]], float], trials: int) -> Trial:
        """Run so many trials; returns the best. A trial that fails with another error is recorded and the search goes on."""
        for _ in range(trials):
            t = Trial(len(self.trials), self.sample())
            self.trials.append(t)

            def heard(epoch: int, score: float, t: Trial = t) -> None:
                t.scores[epoch] = score
                if self._rung(epoch):
                    rivals = sorted((o.scores[epoch] for o in self.trials if epoch in o.scores), reverse=True)
                    if score < rivals[(len(rivals) - 1) // self.factor]:
                        raise Pruned

            try:
                t.value, t.state = float(train(t.params, heard)), "complete"
            except Pruned:
                t.value, t.state = max(t.scores.values()), "pruned"
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                t.state = f"failed: {e}"
        return self.best()

    def best(self) -> Trial:
        done = [t for t in self.trials if t.state == "complete"]
        if not done:
            raise ValueError("no trial was completed")
        return max(done, key=lambda t: (t.value, -t.number))

    def retrain(self, train: Callable[[dict[str, Any], Callable[[int, float], None]], float]) -> float:
        """The best settings again, without pruning."""
        return train(self.best().params, lambda epoch, score: None)

    def summary(self, spark: SparkSession) -> DataFrame:
        """(number, params JSON, value, best, epochs, state), the best value first; best: the largest score on the way."""
        rows = [(t.number, json.dumps(t.params, sort_keys=True), t.value, max(t.scores.values(), default=t.value), len(t.scores), t.state) for t in self.trials]
        return spark.createDataFrame(rows, "number int, params string, value double, best double, epochs int, state string").orderBy(F.desc_nulls_last("value"), "number")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t.number, json.dumps(t.params), t.value, t.state, [(int(e), float(s)) for e, s in t.scores.items()]) for t in self.trials]
        spark.createDataFrame(rows, "number int, params string, value double, state string, scores array<struct<epoch:int,score:double>>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, space: dict[str, Sequence], seed: int = 0) -> Study:
        out = cls(space, seed)
        out.trials = [Trial(r.number, json.loads(r.params), r.value, r.state, {s.epoch: s.score for s in r.scores}) for r in spark.read.parquet(path).orderBy("number").collect()]
        return out


class SharedStudy:
    """A study in a folder of any file system that Spark knows; several drivers run trials of it at once.

    A trial is claimed by creating its file, which succeeds for one driver only. Its settings follow from the study's seed and the trial's number; each
    score is a file of its own, so a rung is judged by what all drivers have written so far, and an interrupted driver leaves its claim and scores behind.

    Layout: about (JSON), claims/N, scores/N/EPOCH, results/N (JSON), models/N.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("about").getFileSystem(conf)
        self.about: dict[str, Any] = json.loads(self._read("about")) if self._fs.exists(self._at("about")) else {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, space: dict[str, Sequence], seed: int = 0, least: int = LEAST, factor: int = FACTOR, **about: Any) -> SharedStudy:
        """A new study, or the one that is there already. about: what the trials need besides, such as the datasets' paths."""
        out = cls(spark, path)
        plain = {n: ["range", *c] if isinstance(c, tuple) else ["choice", *c] for n, c in space.items()}
        if not out.about:
            out._write("about", json.dumps({"space": plain, "seed": seed, "least": least, "factor": factor} | about))
        return cls(spark, path)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> bool:
        """Create a file; False if it is there already."""
        from py4j.protocol import Py4JJavaError

        self._fs.mkdirs(self._at(name).getParent())
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _names(self, folder: str) -> list[int]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().isdigit())

    def params(self, number: int) -> dict[str, Any]:
        space = {n: tuple(c[1:]) if c[0] == "range" else c[1:] for n, c in self.about["space"].items()}
        one = Study(space)
        one._rng = np.random.default_rng([self.about["seed"], number])
        return one.sample()

    def _claim(self, most: int) -> int | None:
        """The next number that nobody has, below `most`."""
        number = max(self._names("claims"), default=-1) + 1
        while number < most:
            if self._write(f"claims/{number}", ""):
                return number
            number += 1
        return None

    def _judged(self, epoch: int, score: float) -> None:
        n, least, factor = epoch + 1, self.about["least"], self.about["factor"]
        while n > least and n % factor == 0:
            n //= factor
        if n != least:
            return
        rivals = sorted((float(self._read(f"scores/{t}/{epoch}")) for t in self._names("scores") if self._fs.exists(self._at(f"scores/{t}/{epoch}"))), reverse=True)
        if score < rivals[(len(rivals) - 1) // factor]:
            raise Pruned

    def run(self, train: Callable[[dict[str, Any], Callable[[int, float], None], str], float], trials: int) -> list[int]:
        """Run trials until the study has so many, by whatever driver; returns the numbers that this one ran. train gets the settings, the callback and a path for the model."""
        ran = []
        while (number := self._claim(trials)) is not None:
            ran.append(number)

            def heard(epoch: int, score: float, number: int = number) -> None:
                self._write(f"scores/{number}/{epoch}", repr(float(score)))
                self._judged(epoch, score)

            value, state = None, "complete"
            try:
                value = float(train(self.params(number), heard, f"{self.path}/models/{number}"))
            except Pruned:
                state = "pruned"
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                state = f"failed: {e}"
            self._write(f"results/{number}", json.dumps({"value": value, "state": state}))
        return ran

    def study(self) -> Study:
        """All trials so far, as a study to ask for its best and its summary; claimed ones without a result are running."""
        out = Study({}, least=self.about["least"], factor=self.about["factor"])
        done = set(self._names("results"))
        for n in self._names("claims"):
            t = Trial(n, self.params(n), scores={e: float(self._read(f"scores/{n}/{e}")) for e in self._names(f"scores/{n}")})
            if n in done:
                found = json.loads(self._read(f"results/{n}"))
                t.value, t.state = found["value"] if found["value"] is not None else max(t.scores.values(), default=None), found["state"]
            out.trials.append(t)
        return out

    def retrain(self, train: Callable[[dict[str, Any], Callable[[int, float], None], str], float], path: str) -> float:
        """The best settings again, without pruning, to `path`."""
        return train(self.study().best().params, lambda epoch, score: None, path)


def topography_trial(spark: SparkSession, about: dict[str, Any]) -> Callable[[dict[str, Any], Callable[[int, float], None], str], float]:
    """The trial of a study of topography models: fit on the dataset `train`, scored on `test`, saved."""
    from genolith.plans.trained import Trained
    from genolith.sources.store import Dataset

    def train(params: dict[str, Any], heard: Callable[[int, float], None], path: str) -> float:
        rest = {n: v for n, v in params.items() if n != "components"}
        test = Dataset(spark, about["test"]) if about.get("test") else None
        m = Trained.fit(Dataset(spark, about["train"]), int(params["components"]), test=test, epochs=about.get("epochs", 20), callback=heard, **rest)
        m.save(path)
        return max(m.topography.scores)

    return train
