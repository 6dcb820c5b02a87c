"""A training run: from corrections to a promoted model, over ports that a trainer and an evaluator fill."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import evaluate, review

#: What a run may come to.
NOTHING, PROMOTE = "nothing_to_learn_from", "promote"


@dataclass(frozen=True)
class TrainingPorts:
    """What a run needs from outside; models are whatever trainer and evaluator agree on, tables are DataFrames."""

    #: Corrections (see review.committed) to learn from.
    corrections: Callable[[], DataFrame]
    #: Page images (page_no, image).
    images: Callable[[], DataFrame]
    #: Writes samples (name, text, image) where the trainer reads them.
    export: Callable[[DataFrame], None]
    #: Trains on what was exported and returns a model.
    train: Callable[[], object]
    #: A report (script, cer, samples) of a model, or of the parent for none, on held-out pages.
    evaluate: Callable[[object | None], DataFrame] | None
    #: Records a promoted model.
    register: Callable[[object, DataFrame], None]


@dataclass(frozen=True)
class Policy:
    least_samples: int = 10
    least_improvement: float = 1.0
    least_height: int = 8


def run_training(ports: TrainingPorts, scripts: list[str], policy: Policy = Policy()) -> tuple[str, object | None]:
    """What the run came to, and the model if it was promoted.

    Without an evaluator nothing is trained, as no model could be promoted.  A
    refusal is an outcome, not an error.
    """
    if ports.evaluate is None:
        raise ValueError("a model can't be promoted without an evaluator")
    samples = review.eligible_samples(ports.corrections(), policy.least_height, scripts)
    if samples.limit(1).count() == 0:
        return NOTHING, None
    ports.export(review.with_images(samples, ports.images()))
    model = ports.train()
    candidate = ports.evaluate(model)
    verdict = evaluate.promotion(candidate, ports.evaluate(None), "test", policy.least_samples, policy.least_improvement).first()["verdict"]
    if verdict != PROMOTE:
        return verdict, None
    ports.register(model, candidate)
    return verdict, model


def training_command(jobs: DataFrame, epochs: int = 10, rate: float = 1e-4, timeout: int = 7200) -> DataFrame:
    """jobs (folder, parent, device) with the arguments and the seconds that an external trainer is given."""
    start = F.when(F.col("parent").isNotNull(), F.array(F.lit("-i"), F.col("parent"))).otherwise(F.array().cast("array<string>"))
    fixed = ["--epochs", str(epochs), "--quit", "fixed", "--lrate", str(rate)]
    args = F.concat(F.array(F.lit("--device"), F.col("device"), F.lit("train")), start, F.array(*map(F.lit, fixed)), F.array(F.concat("folder", F.lit("/images/*.png"))))
    return jobs.withColumns({"arguments": args, "timeout_s": F.lit(timeout)})
