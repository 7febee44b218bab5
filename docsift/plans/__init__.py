"""The query catalogue; importing it registers the queries of all its modules."""

from docsift.plans import catalog, reviews  # noqa: F401
