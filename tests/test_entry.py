import importlib.util

import __spark_entry__ as entry


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 50
    assert entry.entry(spark).count() == 5


def test_only_absent_modules_are_optional():
    assert entry._absent("corpus_pipeline", "corpus_pipeline")
    assert entry._absent("corpusloom.llm.queries", "corpusloom.llm")
    assert not entry._absent("corpusloom.llm.queries", "numpy_") and not entry._absent("corpusloom.llm.queries", None)
    # A misspelt module within a subpackage that is there is an error; without the subpackage it is part of what is absent.
    here = importlib.util.find_spec("corpusloom.llm") is not None
    assert entry._absent("corpus_pipeline", "corpusloom.llm.nothing") is not here
