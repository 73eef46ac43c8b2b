import importlib
import pathlib
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150
    for n in range(1, 6):
        assert f"p{n}_found" in q


def test_core_does_not_import_llm():
    root = pathlib.Path(entry.__file__).parent / "spanweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"spanweave\.llm|from \.+llm", p.read_text()), p


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    importlib.reload(entry)
