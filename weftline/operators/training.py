"""Training and generation by models from outside: their interfaces, and what is decided around them.

No deep model comes with this engine. What a loop over epochs keeps, when it stops, which rows it holds out and
which adapter answers is decided here, so that any model with these methods can be put in.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import classify
from weftline.runtime import logger
from weftline.session import cut

log = logger(__name__)


class Trainer(Protocol):
    """A classifier that learns by epochs (a network on one machine, or one behind a distributor)."""

    def epoch(self, rows: DataFrame, weights: dict[str, float]) -> float:
        """One pass over the training rows, losses weighted by label; the mean loss."""

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``y_pred``."""

    def keep(self) -> None:
        """Hold the present parameters as the best so far."""

    def restore(self) -> None:
        """Return to the parameters held."""


class Tuner(Protocol):
    """What trains an adapter on records of prompt and completion."""

    def loss(self, rows: DataFrame) -> float: ...

    def fit(self, rows: DataFrame, epochs: int) -> None: ...

    def save(self, path: str) -> None: ...


class Generator(Protocol):
    """A model that answers messages; each state of the growing reply is yielded whole."""

    def stream(self, messages: list[dict], adapter: str | None) -> Iterator[str]: ...


def early_stop(scores: Column, patience: int = 2) -> Column:
    """``(best_epoch, best, epochs)`` of an array of scores by epoch, epochs counted from 1.

    Training ends once ``patience`` epochs in a row were not above the best; of equal scores the first counts.
    """
    state = "struct<best:double,at:int,seen:int>"
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("seen")).cast(state)

    def step(acc: Column, score: Column) -> Column:
        better, number = score > acc["best"], acc["seen"] + 1
        after = F.struct(F.when(better, score).otherwise(acc["best"]).alias("best"), F.when(better, number).otherwise(acc["at"]).alias("at"), number.alias("seen")).cast(state)
        return F.when(acc["seen"] - acc["at"] >= patience, acc).otherwise(after)

    done = F.aggregate(F.transform(scores, lambda s: s.cast("double")), start, step)
    return F.struct(done["at"].alias("best_epoch"), done["best"].alias("best"), done["seen"].alias("epochs"))


def fine_tune(trainer: Trainer, rows: DataFrame, label: str, epochs: int = 4, patience: int = 2) -> dict:
    """Trains on ``split`` train, keeps the epoch of best macro-F1 on val, and judges it on test, once."""
    rows = cut(rows)
    train, val, test = (rows.filter(F.col("split") == split) for split in ("train", "val", "test"))
    weights = {str(r[label]): r["weight"] for r in classify.class_weights(train, label).collect()}  # one row a class
    labels = sorted(weights)
    history, best, best_epoch = [], float("-inf"), 0
    for epoch in range(1, epochs + 1):
        loss = trainer.epoch(train, weights)
        score = classify.judge(trainer.predict(val), label, labels)["macro_f1"]
        history.append({"epoch": epoch, "loss": loss, "val_macro_f1": score})
        log.info("epoch %d: loss %.4f, macro-F1 %.4f", epoch, loss, score)
        if score > best:
            best, best_epoch = score, epoch
            trainer.keep()
        elif epoch - best_epoch >= patience:
            break
    trainer.restore()
    return {**classify.judge(trainer.predict(test), label, labels), "best_val_macro_f1": best, "best_epoch": best_epoch, "history": history}


def held_out(records: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Records with ``held_out``, drawn by a hash of prompt and completion: copies fall on one side."""
    drawn = F.conv(F.substring(classify.order_key(F.to_json(F.struct("prompt", "completion")), seed), 1, 8), 16, 10).cast("long")
    return records.withColumn("held_out", drawn < int(share * 2**32))


def tune_adapter(tuner: Tuner, records: DataFrame, path: str, epochs: int = 2, share: float = 0.1, seed: int = 42) -> dict:
    """An adapter trained on records but for those held out, whose loss is taken before and after; saved at ``path``."""
    rows = cut(held_out(records, share, seed))
    train, rest = rows.filter("not held_out"), rows.filter("held_out")
    before = tuner.loss(rest)
    tuner.fit(train, epochs)
    after = tuner.loss(rest)
    tuner.save(path)
    return {"examples": train.count(), "held_out": rest.count(), "epochs": epochs, "loss_before": round(before, 4), "loss_after": round(after, 4)}


def has_adapter(folder: str, character: str) -> bool:
    return (Path(folder) / character / "adapter_config.json").exists()


def answer(generator: Generator, messages: list[dict], character: str, adapters: str | None = None) -> Iterator[str]:
    """States of a growing reply, by the character's own adapter where there is one."""
    own = str(Path(adapters) / character) if adapters and has_adapter(adapters, character) else None
    return generator.stream(messages, own)
