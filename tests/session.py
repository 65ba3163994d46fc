"""The local session of the package, under its name in tests."""

from tabkit.session import get_session  # noqa: F401
