import pytest

from tidegate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(name, compare):
    compare(queries.QUERIES[name], queries.ORACLE[name])


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidegate.llm" not in f.read_text()
