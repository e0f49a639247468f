"""Alert triage end to end: logs, groups, rules, model, results."""

from pyspark.sql import DataFrame

from .. import fixed_values as V
from ..operators.dedup import ungrouped
from ..operators.rules import with_rule
from ..operators.scoring import ChatFactory, classify
from ..operators.windows import anchored_windows, with_representatives


def triage(
    logs: DataFrame,
    chat_factory: ChatFactory | None = None,
    responses: DataFrame | None = None,
    rules: list[tuple] | DataFrame | None = None,
    use_rules: bool = True,
    use_aggregation: bool = True,
    window_seconds: float = V.WINDOW_SECONDS,
    threshold: int = V.STORM_THRESHOLD,
    parts: int | None = None,
    eager: bool = False,
) -> DataFrame:
    """Triage results of a log table.

    Dedup comes before the rules and the rules before the model, so that each
    step sees only what the one before it left over.
    """
    if use_aggregation:
        groups = with_representatives(anchored_windows(logs, window_seconds, threshold, eager), logs)
    else:
        groups = ungrouped(logs)
    ruled = with_rule(groups, rules=rules if use_rules else [])
    return classify(ruled, chat_factory, responses, parts=parts)
