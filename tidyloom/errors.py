"""Errors that are safe to show to whoever wrote the recipe."""


class RecipeError(ValueError):
    """The recipe, filter or metric does not fit this dataset."""


class SourceError(ValueError):
    """A file or folder cannot be taken in."""
