import pytest

pytest.importorskip("marketweave.llm")
