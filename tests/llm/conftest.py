from tests.conftest import DATA  # noqa: F401
