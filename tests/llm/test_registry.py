import ast
from pathlib import Path

import __spark_entry__ as entry
from reportloom.llm import registry

ROOT = Path(entry.__file__).parent


def test_a_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted({n.split("_")[0] for n in names}) == sorted(["pipeline", *(f"op{n}" for n in range(1, 14))])
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "reportloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "reportloom.llm" not in path.read_text(), path


def test_native_operators_run_no_python():
    banned = ("mapIn", "applyIn", "pandas", "pyarrow", "udf", ".rdd")
    for name in ("licences", "mixing", "spotsigs", "components", "cluster"):
        text = (ROOT / "reportloom" / "llm" / f"{name}.py").read_text()
        assert not [b for b in banned if b in text], name
        ast.parse(text)
