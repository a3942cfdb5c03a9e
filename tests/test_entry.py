"""The entry point without the training-data operators, or without what they need."""

import subprocess
import sys

from conftest import ROOT

from tidewind import oracle, queries


def names_without(*modules):
    code = f"import sys; sys.modules.update(dict.fromkeys({modules!r})); import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    made, sql = done.stdout.split("|")
    return set(made.split()), set(sql.split())


def test_other_queries_outlive_a_missing_module():
    for modules in (("xxhash",), ("public_tokenizers",), ("tidewind.llm",)):
        assert names_without(*modules) == (set(queries.queries()), set(oracle.oracle_sql()))


def test_a_missing_pipeline_takes_nothing_else():
    made, sql = names_without("corpus_pipeline")
    assert "pipeline" not in made and made >= set(queries.queries()) and sql <= made
