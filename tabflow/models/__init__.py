"""Estimators: ``fit_*(train, features, label, **params) -> FittedModel``.

``FittedModel.transform(df)`` adds ``prediction`` (in the label's own values) and,
for classifiers that have them, ``probability`` (array ordered like ``classes``).
"""

from tabflow.models.base import FittedModel  # noqa: F401
