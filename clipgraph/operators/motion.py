"""Motion scores and the filter that keeps static clips away from the model."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays


def mean_abs_diff(a: Column, b: Column) -> Column:
    return arrays.array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def motion_scores(frames: DataFrame, clip: list[str], local: str, n: str, gray: str = "gray") -> DataFrame:
    """Largest mean gray change of the first, middle and last frame of each clip; 0 below two frames.

    ``local`` is the position in the clip and ``n`` its length, so only the three frames that
    matter go through the shuffle.
    """
    at, size = F.col(local), F.col(n)
    middle = F.floor(size / 2)
    used = frames.where((at == 0) | (at == middle) | (at == size - 1))

    def pick(where: Column) -> Column:
        return F.first(F.when(where, F.col(gray)), ignorenulls=True)

    three = used.groupBy(*clip, n).agg(
        pick(at == 0).alias("_first"), pick(at == middle).alias("_mid"), pick(at == size - 1).alias("_last")
    )
    change = F.greatest(mean_abs_diff(F.col("_first"), F.col("_mid")), mean_abs_diff(F.col("_mid"), F.col("_last")))
    return three.select(*clip, F.col(n).alias("n_frames"), F.when(size < 2, F.lit(0.0)).otherwise(change).alias("motion_score"))


def annotate_clips(prompts: DataFrame, clip: list[str], call: Callable[[str], str], prompt: str = "user_prompt") -> DataFrame:
    """Run a model over clip rows: ``raw`` text and ``error`` per clip.

    ``call`` maps one prompt to one text. A clip whose call fails gets the error text and no
    raw text; the other clips of the task go on.
    """
    schema = ", ".join(f"{c} {prompts.schema[c].dataType.simpleString()}" for c in clip) + ", raw string, error string"

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for p in batch[prompt]:
                try:
                    texts.append(call(p))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(str(e))
            yield batch[clip].assign(raw=texts, error=errors)

    return prompts.select(*clip, prompt).mapInPandas(run, schema)


def in_flight(pool: ThreadPoolExecutor, call: Callable[[dict], str], requests: Iterable[dict], most: int) -> Iterator[tuple[str | None, str | None]]:
    """(text, error) of each request in order, with at most ``most`` requests under way."""
    open_: deque[Future] = deque()

    def answer(done: Future) -> tuple[str | None, str | None]:
        error = done.exception()
        return (None, str(error) or type(error).__name__) if error else (done.result(), None)

    for request in requests:
        if len(open_) == most:
            yield answer(open_.popleft())
        open_.append(pool.submit(call, request))
    while open_:
        yield answer(open_.popleft())


def annotate_batches(
    prompts: DataFrame, clip: list[str], client: Callable[[], Any], fields: list[str], most: int = 8,
) -> DataFrame:
    """Run a model over clip rows with one client a task and several requests under way: ``raw`` and ``error`` per clip.

    ``client`` makes the client of a task when its first row arrives; the client is called with one request, a
    dictionary of the columns ``fields`` (prompts, frame numbers, images as arrays of binary), from up to ``most``
    threads at a time, and closed at the end if it has ``close``. Answers stay in the order of the rows.

    A clip whose call fails gets the text of its error and no raw text; the others of the task go on. A task
    whose client cannot be made fails. A task that is repeated asks again. Rows come in Arrow
    batches, of which a task holds one; for large images lower ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    if most < 1:
        raise ValueError("at least one request must be allowed")
    schema = ", ".join(f"{c} {prompts.schema[c].dataType.simpleString()}" for c in clip) + ", raw string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        with ThreadPoolExecutor(most) as pool:
            try:
                for batch in batches:
                    if not len(batch):
                        continue
                    model = client() if model is None else model
                    requests = (dict(zip(fields, row, strict=True)) for row in batch[fields].itertuples(index=False, name=None))
                    said = list(in_flight(pool, model, requests, most))
                    yield batch[clip].assign(raw=[t for t, _ in said], error=[e for _, e in said])
            finally:
                if hasattr(model, "close"):
                    model.close()

    return prompts.select(*dict.fromkeys([*clip, *fields])).mapInPandas(run, schema)


def annotate_moving(
    clips: DataFrame, clip: list[str], threshold: float, call: Callable[[str], str] | None = None, prompt: str = "user_prompt",
    client: Callable[[], Any] | None = None, fields: list[str] | None = None, most: int = 8,
) -> DataFrame:
    """Send only clips with ``motion_score`` at the threshold to the model and put the rest back empty.

    The model is ``call`` for one prompt at a time, or ``client`` as in :func:`annotate_batches`.
    """
    moving = clips.where(F.col("motion_score") >= threshold)
    said = annotate_batches(moving, clip, client, fields or [prompt], most) if client else annotate_clips(moving, clip, call, prompt)
    return clips.join(said, clip, "left").withColumn("inferred", F.col("motion_score") >= threshold)
