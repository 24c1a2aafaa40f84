"""Named queries over the sample tables; importing this package registers them."""

from . import numbers, places, relational, scalars, statistics  # noqa: F401
