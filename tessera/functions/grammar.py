"""Predicates on sentences by a tagger that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: A tagged word: its tag, its relation, and the place of its head in the sentence (its own for the root).
Word = tuple[str, str, int]


def has_imperative(make_tagger: Callable[[], Callable[[str], list[Word]]]) -> Callable[[Column], Column]:
    """A column function: whether the root of a text is a bare verb (``VB``) without a subject (``nsubj``).

    ``make_tagger`` is called once a task, so a model is loaded there and not a row.
    A null or empty text has none.
    """

    @F.pandas_udf(BooleanType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tag = make_tagger()

        def imperative(text: str | None) -> bool:
            words = tag(text) if text else []
            roots = [i for i, (_, relation, _) in enumerate(words) if relation == "ROOT" and words[i][0] == "VB"]
            return any(not any(relation == "nsubj" and head == i for _, relation, head in words) for i in roots)

        for texts in batches:
            yield texts.map(imperative)

    return run
