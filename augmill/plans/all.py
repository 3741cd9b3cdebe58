"""Import every plan module so that its queries register."""

from augmill.plans import (augment_plans, corpus_plans, io_plans, lexicon_plans, metric_plans,  # noqa: F401
                           nearest_plans, score_plans, split_plans, text_plans)  # noqa: F401
from augmill.plans.registry import ORACLE, QUERIES  # noqa: F401
