"""Labels of media items by a model that is handed in, with a cascade of models and open failure."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import answer_text, numbered
from gleaner.operators.matching import first_equal
from gleaner.sources.scratch import materialize

#: Takes frames of requests, returns for each row the raw answers of all models in order: {"status": ..., "text": ...}, null status for none.
LabelFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
ANSWERS = T.ArrayType(T.StructType([T.StructField("status", T.IntegerType()), T.StructField("text", T.StringType())]))
#: Fixed value: the status that ends a cascade at once.
BLOCKED = 403


def prompt(place: Column, menu: Column, popular: Column, items: Column) -> Column:
    """What a model is asked: by list of the menu, by list of popular names, or freely."""
    head = F.concat(F.lit("Name the dish or drink in this photo from "), place, F.lit(". "))
    ask = F.lit("\nAnswer with an item of the list, word for word; with 2 to 5 words if what is shown is not listed; with null if there is no food or drink.")
    listed = lambda what: F.concat(head, F.lit(what + "\n"), numbered(items), ask)
    free = F.concat(head, F.lit("Answer with 2 to 5 words, or with null if there is no food or drink."))
    return F.when(F.size(menu) > 0, listed("Menu:")).when(F.size(popular) > 0, listed("Often ordered:")).otherwise(free)


def outcome(answers: Column) -> Column:
    """Of answers in cascade order, the first that is a success or blocks; null if there is none."""
    return F.get(F.filter(answers, lambda a: a["status"].between(200, 299) | (a["status"] == BLOCKED)), F.lit(0))


def interpret(rows: DataFrame, answers: str = "answers", items: str = "items", fetched: str = "fetched") -> DataFrame:
    """rows with name, is_match and is_food.

    An item that could not be fetched, a blocked model, or a cascade in which all fail counts as food without a name. An empty answer
    or null is no food. Otherwise the name is the item of the list that the answer equals, as it is written there, else the answer.
    """
    out = rows.withColumn("_answer", F.when(F.col(fetched), outcome(F.col(answers))))
    open_ = F.col("_answer").isNull() | (F.col("_answer.status") == BLOCKED)
    text = F.when(~open_, answer_text(F.col("_answer.text")))
    found = F.when(text.isNotNull(), first_equal(text, F.col(items)))
    out = out.withColumn("name", F.coalesce(found, text)).withColumn("is_match", F.coalesce(F.length(found) > 0, F.lit(False)))
    return out.withColumn("is_food", open_ | text.isNotNull()).drop("_answer")


def label(requests: DataFrame, model: LabelFunction, schema: T.StructType, parallel: int | None = None) -> DataFrame:
    """Runs the model over requests by mapInPandas and interprets its answers. schema: of what the model returns."""
    if parallel:
        requests = requests.repartition(parallel)
    return interpret(requests.mapInPandas(model, schema))


#: Asks one model about one request, a dict of its columns: a status and a text.
Ask = Callable[[dict], tuple[int | None, str | None]]


class _Caller:
    """A thread that makes one call after the other. What it is given is an `ask`, a row, a list and the place in it for the answer."""

    def __init__(self, done: queue.SimpleQueue):
        self.given: queue.SimpleQueue = queue.SimpleQueue()
        self.done = done
        threading.Thread(target=self.run, daemon=True).start()

    def run(self) -> None:
        while (job := self.given.get()) is not None:
            ask, row, got, i = job
            try:
                got[i] = ask(row)
            except BaseException:  # noqa: BLE001  a model that fails is passed over, whatever its failure
                got[i] = (None, None)
            self.done.put(self)


class Callers:
    """Up to at_once threads that are kept between calls; where a call takes longer than `seconds`, the next wave starts with new ones."""

    def __init__(self, at_once: int, seconds: float):
        self.at_once, self.seconds = at_once, seconds
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        self.idle: list[_Caller] = []

    def __enter__(self) -> Callers:
        return self

    def __exit__(self, *_: object) -> None:
        for caller in self.idle:
            caller.given.put(None)
        self.idle = []

    def wave(self, ask: Ask, rows: Sequence[dict]) -> list[tuple[int | None, str | None]]:
        """The answers to at most at_once rows, all asked at once."""
        got: list = [(None, None)] * len(rows)
        busy: set[_Caller] = set()
        for i, row in enumerate(rows):
            caller = self.idle.pop() if self.idle else _Caller(self.done)
            busy.add(caller)
            caller.given.put((ask, row, got, i))
        ends = time.monotonic() + self.seconds
        while busy:
            try:
                caller = self.done.get(timeout=max(0.0, ends - time.monotonic()))
            except queue.Empty:
                break
            busy.discard(caller)
            self.idle.append(caller)
        if busy:
            # Those end when their call does: what they say then is heard by nobody. Idle ones would answer to the old queue.
            for caller in [*busy, *self.idle]:
                caller.given.put(None)
            self.done, self.idle = queue.SimpleQueue(), []
        return list(got)  # a copy: what comes late is not heard


def ask_all(ask: Ask, rows: Sequence[dict], at_once: int, seconds: float) -> list[tuple[int | None, str | None]]:
    """Answers in order, at most at_once calls at a time. A call that raises, or takes longer, counts as none: (None, None)."""
    with Callers(at_once, seconds) as callers:
        return [answer for k in range(0, len(rows), at_once) for answer in callers.wave(ask, rows[k : k + at_once])]


def label_staged(requests: DataFrame, models: Sequence[Ask], parallel: int | None = None, at_once: int = 4, seconds: float = 20.0) -> DataFrame:
    """requests (with items and fetched) with name, is_match and is_food, by a cascade in which each model is asked only about what the
    models before it failed at: one that was answered, or blocked, goes no further, and one that could not be fetched is never asked.

    Every stage is written once, so no call is made again for what a later stage or a lost task needs. Calls are bounded by `parallel` tasks, of
    at_once calls each, and by seconds; without `parallel` the tasks are twice Spark's cores, however few files the requests lie in. All columns
    of requests go to the model, but those that a stage adds.
    """
    todo = requests.withColumn("answers", F.array().cast(ANSWERS))
    parts = [todo.where(~F.coalesce(F.col("fetched"), F.lit(False)))]
    todo = todo.where("fetched")
    schema = T.StructType([*todo.drop("answers").schema.fields, T.StructField("answers", ANSWERS)])
    names = requests.columns

    def stage(ask: Ask) -> LabelFunction:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = ask_all(ask, pdf[names].to_dict("records"), at_once, seconds)
                before = pdf["answers"].tolist()
                pdf["answers"] = [[*([] if b is None else list(b)), {"status": s, "text": t}] for b, (s, t) in zip(before, found)]
                yield pdf

        return run

    tasks = parallel or 2 * requests.sparkSession.sparkContext.defaultParallelism
    for model in models:
        todo = todo.repartition(tasks)
        told = materialize(todo.mapInPandas(stage(model), schema), "answers")
        ended = outcome(F.col("answers")).isNotNull()
        parts.append(told.where(ended))
        todo = told.where(~ended)
    parts.append(todo)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return interpret(every).select(*names, "name", "is_match", "is_food")
