"""Foundation-model detection and endpoint descriptions over nested entities.

Both work on the ``served_entities`` array in place with higher-order
functions, so normalising an endpoint feed needs no explode and no shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F

from .text import is_truthy, truthy_or

# Entity-name prefixes that mark a platform foundation model.
FOUNDATION_PREFIXES = (
    "databricks-claude",
    "databricks-gpt",
    "databricks-llama",
    "databricks-dbrx",
    "databricks-meta",
    "databricks-mistral",
    "databricks-gte",
    "databricks-bge",
)
FOUNDATION_SUFFIX = " (Foundation Model)"


def _effective_name(e: Column) -> Column:
    # entity_name wins when truthy, otherwise the entity's own name
    return truthy_or(e["entity_name"], e["name"])


def _entity_is_foundation(e: Column, prefixes: Sequence[str]) -> Column:
    name = _effective_name(e)
    by_prefix = F.lit(False)
    for prefix in prefixes:
        by_prefix = by_prefix | name.startswith(prefix)
    return e["external_model"].isNotNull() | (is_truthy(name) & by_prefix)


def is_foundation(entities: Column, prefixes: Sequence[str] = FOUNDATION_PREFIXES) -> Column:
    """True when any served entity is an external model or has a foundation prefix."""
    return F.coalesce(F.exists(entities, lambda e: _entity_is_foundation(e, prefixes)), F.lit(False))


def any_foundation(entities: "DataFrame", key: str = "endpoint",
                   prefixes: Sequence[str] = FOUNDATION_PREFIXES) -> "DataFrame":
    """Foundation flag per endpoint from exploded entity rows (one row per
    entity with ``name``, ``entity_name``, ``external_model``): ``bool_or`` is
    mergeable, so a huge endpoint is combined map-side."""
    e = F.struct(*[F.col(c) for c in ("name", "entity_name", "external_model")])
    return entities.groupBy(key).agg(F.bool_or(_entity_is_foundation(e, prefixes)).alias("is_foundation_model"))


def entity_display_name(e: Column, prefixes: Sequence[str]) -> Column:
    label = truthy_or(e["entity_name"], e["name"], F.lit("Unknown"))
    return F.when(_entity_is_foundation(e, prefixes), F.concat(label, F.lit(FOUNDATION_SUFFIX))).otherwise(label)


def endpoint_description(description: Column, entities: Column, models: Column,
                         prefixes: Sequence[str] = FOUNDATION_PREFIXES) -> Column:
    """Description of a serving endpoint.

    Entities present: own description when truthy, else ``Serving: a, b (Foundation Model)``
    in entity order.  No entities but legacy models: ``Serving models: …`` (replaces the
    own description, as the feed reader did).  Otherwise the own description or ''.
    """
    has_entities = F.coalesce(F.size(entities) > 0, F.lit(False))
    model_names = F.filter(F.transform(models, lambda m: m["model_name"]), lambda n: n.isNotNull())
    has_models = F.coalesce(F.size(model_names) > 0, F.lit(False))
    serving = F.concat(F.lit("Serving: "),
                       F.array_join(F.transform(entities, lambda e: entity_display_name(e, prefixes)), ", "))
    return (F.when(has_entities, truthy_or(description, serving))
            .when(has_models, F.concat(F.lit("Serving models: "), F.array_join(model_names, ", ")))
            .otherwise(F.coalesce(description, F.lit(""))))
