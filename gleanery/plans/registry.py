"""Every query of the library outside the training-data subpackage."""

from . import depth, linking, review, screening, structure  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
