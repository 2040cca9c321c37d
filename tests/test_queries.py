import subprocess
import sys
from pathlib import Path

import pytest
from oracle import assert_same

from quadloom.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_oracle(spark, name):
    assert_same(spark, DATA, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_an_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_nothing_else_imports_the_training_data_subpackage():
    files = [p for p in (ROOT / "quadloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert files and not any("llm" in line for p in files for line in p.read_text().splitlines() if "import" in line)


def test_entry_works_without_that_subpackage(tmp_path):
    for p in ROOT.rglob("*.py"):
        rest = p.relative_to(ROOT)
        if "llm" in rest.parts or rest.name == "corpus_pipeline.py" or rest.parts[0] == "tests":
            continue
        target = tmp_path / rest
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(p.read_text())
    code = "import __spark_entry__ as e; assert 'affected_tiles' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_works_without_the_tokenizer_libraries():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; assert 'affected_tiles' in e.queries() and 'op5_packing' not in e.queries() and 'etag' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
