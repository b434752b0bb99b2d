"""The entry points with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(before: str) -> tuple[set[str], set[str]]:
    code = f"import sys; {before}; import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    found = {line.split()[0]: set(line.split()[1:]) for line in out.splitlines() if line.startswith(("NAMES", "SQL"))}
    return found["NAMES"], found["SQL"]


def test_record_queries_need_no_optional_module():
    for gone in ("public_tokenizers", "corpus_pipeline", "tessera.llm", "numpy.nothing"):
        got, sql = names(f"sys.modules[{gone!r}] = None")
        assert {"recfm_f", "revenue_by_flag", "ebcdic_scan"} <= got and sql <= got
        if gone != "numpy.nothing":
            assert not any(n.startswith("op") for n in got)


def test_every_record_query_has_sql():
    from tessera import queries

    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()
