"""Field standardisation: five rule profiles that disagree on purpose and share no rule constants.

Every profile is one projection over the fields table: native expressions only, no shuffle except where
a composite needs several fields of one entry.
"""

from docfields.operators.standardize.bnr import standardize_bnr
from docfields.operators.standardize.confidence import clamp_confidence, repair_confidence
from docfields.operators.standardize.model import adapt_model_fields, normalise_by_type
from docfields.operators.standardize.ocr import standardize_ocr
from docfields.operators.standardize.post import standardize_post
from docfields.operators.standardize.schema import standardize_schema

__all__ = [
    "adapt_model_fields", "clamp_confidence", "normalise_by_type", "repair_confidence", "standardize_bnr",
    "standardize_ocr", "standardize_post", "standardize_schema",
]
