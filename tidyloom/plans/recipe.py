"""Recipes: validation, folding into a plan, and the columns they name.

A recipe is ``{"version": 1, "steps": [...], "metrics": [...]}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tidyloom.errors import RecipeError
from tidyloom.operators import filters
from tidyloom.operators.metrics import OPERATIONS, ROW_OPERATIONS
from tidyloom.operators.steps import STATELESS, STEPS
from tidyloom.plans.frame import Frame, frame_of

MAX_STEPS = 50
MAX_METRICS = 50
MAX_SORT_KEYS = 10
MAX_REPLACEMENTS = 200

# Default labels of the steps in reports.
STEP_LABELS = {
    "filter": "Filtrar registros",
    "drop_duplicates": "Remover duplicados",
    "drop_empty_rows": "Remover linhas vazias",
    "select_columns": "Manter apenas colunas",
    "drop_columns": "Remover colunas",
    "rename_columns": "Renomear colunas",
    "sort": "Ordenar",
    "cast": "Converter tipo",
    "replace_values": "Substituir valores",
    "fill_empty": "Preencher vazios",
}

COLUMN_LISTS = ("drop_duplicates", "drop_empty_rows", "select_columns", "drop_columns")
ONE_COLUMN = ("cast", "replace_values", "fill_empty")


def validate(recipe: dict) -> None:
    """Refuse a recipe that is malformed, whatever dataset it meets."""
    if recipe.get("version", 1) != 1:
        raise RecipeError(f'Unknown recipe version: "{recipe["version"]}".')
    steps, metrics = recipe.get("steps") or [], recipe.get("metrics") or []
    if len(steps) > MAX_STEPS:
        raise RecipeError(f"A recipe may have at most {MAX_STEPS} steps.")
    if len(metrics) > MAX_METRICS:
        raise RecipeError(f"A recipe may have at most {MAX_METRICS} metrics.")
    for step in steps:
        _validate_step(step)
    for metric in metrics:
        validate_metric(metric)


def _validate_step(step: dict) -> None:
    kind = step.get("kind")
    if kind not in STEPS:
        raise RecipeError(f'Unknown step: "{kind}".')
    if kind == "filter":
        filters.validate(step.get("filter") or {})
    if kind in ("select_columns", "drop_columns") and not step.get("columns"):
        raise RecipeError(f'The step "{kind}" must name at least one column.')
    if kind in ONE_COLUMN and not step.get("column"):
        raise RecipeError(f'The step "{kind}" must name a column.')
    if kind == "cast" and step.get("to") not in ("text", "number", "date", "boolean"):
        raise RecipeError(f'A column cannot be cast to "{step.get("to")}".')
    if kind == "fill_empty" and step.get("value") is None:
        raise RecipeError("A fill step needs a value.")
    _validate_length(step, "sort", "by", MAX_SORT_KEYS)
    _validate_length(step, "replace_values", "replacements", MAX_REPLACEMENTS)
    _validate_length(step, "rename_columns", "mapping", 500)


def _validate_length(step: dict, kind: str, key: str, most: int) -> None:
    if step["kind"] == kind and not 1 <= len(step.get(key) or []) <= most:
        raise RecipeError(f'The step "{kind}" needs 1 to {most} entries in "{key}".')


def validate_metric(metric: dict) -> None:
    if not metric.get("id"):
        raise RecipeError("A metric needs an id.")
    if metric.get("operation") not in OPERATIONS:
        raise RecipeError(f'Unknown operation: "{metric.get("operation")}".')
    if metric["operation"] not in ROW_OPERATIONS and not metric.get("column"):
        raise RecipeError(f'The operation "{metric["operation"]}" needs a column.')


def needs_order(recipe: dict) -> bool:
    """Whether the rows that come out depend on the order of rows."""
    return any(
        step.get("kind") == "drop_duplicates" and step.get("keep", "first") != "none"
        for step in recipe.get("steps") or []
    )


def is_stateless(recipe: dict) -> bool:
    return all(step["kind"] in STATELESS for step in recipe.get("steps") or [])


def referenced_columns(recipe: dict) -> list[str]:
    """Columns a recipe names, in order of first mention."""
    names: list[str] = []
    for step in recipe.get("steps") or []:
        kind = step.get("kind")
        if kind == "filter":
            names += filters.referenced_columns(step["filter"])
        elif kind in COLUMN_LISTS:
            names += step.get("columns") or []
        elif kind in ONE_COLUMN:
            names.append(step["column"])
        elif kind == "rename_columns":
            names += [entry["from"] for entry in step["mapping"]]
        elif kind == "sort":
            names += [entry["column"] for entry in step["by"]]
    names += [m["column"] for m in recipe.get("metrics") or [] if m.get("column")]
    return list(dict.fromkeys(names))


def apply_steps(frame: Frame, recipe: dict, strict_types: bool = False) -> Frame:
    """Run the steps of a recipe in order. Nothing is computed yet.

    With ``strict_types`` a filter may only use the operators offered for a column's type.
    """
    validate(recipe)

    def step_on(f: Frame, step: dict) -> Frame:
        if strict_types and step["kind"] == "filter":
            filters.predicate(step["filter"], f.schema, strict_types=True)
        return STEPS[step["kind"]](f, step)

    return reduce(step_on, recipe.get("steps") or [], frame)


def run(
    df: DataFrame,
    recipe: dict,
    types: dict[str, str] | None = None,
    order_by: list[str] | None = None,
    group_by: list[str] | None = None,
    ordered: bool = False,
    strict_types: bool = False,
) -> Frame:
    """Frame of a recipe on a DataFrame.

    The original position is read from the files only if a step needs it, or if
    ``ordered`` asks for the rows in their order.
    """
    anchored = not order_by and (ordered or needs_order(recipe))
    return apply_steps(frame_of(df, types, order_by, group_by, anchored), recipe, strict_types)
