import subprocess
import sys

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, folder):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_llm_subpackage():
    code = "import sys; sys.modules['tallyloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('p4_') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
