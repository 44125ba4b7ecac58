"""Every fold of a benchmark evaluated, with a partnerless variant of each if wanted, and the spread over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import matching as M
from ..sources import get_loader
from ..sources.store import save_temporarily
from ..storage import stored

FOLDS = (1, 2, 3, 4, 5)


def run_folds(spark: SparkSession, datasets: dict[str, str], matchers: list[tuple[str, dict]], folds=FOLDS, match_ratio: float | None = None, seed: int = 42, split: str = "test", skip: str = "100K") -> DataFrame:
    """(dataset, fold, matcher, scores): datasets (name to path) whose name holds `skip` are left out, as five runs of them take too long.

    With match_ratio each fold is evaluated on a variant in which part of the entities has lost its partner. The result
    goes to evaluate.fold_variance() and spread().
    """
    out = None
    for name, path in datasets.items():
        if skip and skip in name:
            continue
        for fold in folds:
            pair = get_loader("openea", fold=fold).load(spark, path).with_frames(name=name)
            pair = save_temporarily(pair if match_ratio is None else E.inject_non_matches(pair, match_ratio, seed))
            for kind, options in matchers:
                matcher = M.get_matcher(kind, **options)
                found = stored(matcher.match(pair, pair.matched("train").select("e1", "e2") if matcher.requires_seeds else None), "predictions")
                row = E.evaluate(found, pair, split).select(F.lit(name).alias("dataset"), F.lit(fold).cast("long").alias("fold"), F.lit(kind).alias("matcher"), "*")
                out = row if out is None else out.union(row)
    if out is None:
        raise ValueError("no dataset to run")
    return out
