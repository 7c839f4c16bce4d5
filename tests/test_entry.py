"""The driver's contract, without Spark work."""

import subprocess
import sys

import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"leak_findings", "content_edges", "covers_drift"} <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_subpackage():
    code = (
        "import sys; sys.modules['docweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')] and len(q) > 30, q"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0])
