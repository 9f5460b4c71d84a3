from __future__ import annotations

import pytest

from tests.session import new_session


@pytest.fixture(scope="session")
def spark():
    return new_session()
