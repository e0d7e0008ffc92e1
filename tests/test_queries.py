import pytest

from variorum import queries as Q

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, Q.QUERIES[name], Q.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_passages_inside_words_after_tabs_and_short(spark, tmp_path):
    from pathlib import Path

    for f in Path(SF).iterdir():
        (tmp_path / f.name).symlink_to(f)
    ten, long = "one two three four five six seven eight nine ten", "aa bb cc dd ee ff gg hh ii jj kk ll mm"
    passages = [long, ten, "nearly\tthere by now", "word", "q w  e r t y u i o p a s", "tail one two three four five six seven eight nine ten eleven "]
    texts = [f'he said "{long}"', f"a\t{long}\nb", f"x{long}y z", long, f"({ten})", "so nearly\tthere by nowhere", "so nearly there by now", "swords", "q w  e r t y u i o p a s"]
    texts += ["q w e r t y u i o p a s", "cocktail one two three four five six seven eight nine ten eleven twelve", "aa bb cc", "", None, long[1:], long.upper()]
    tables = {
        "documents": spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"),
        "labels": spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(list(enumerate([*passages, None])), "item_id long, text string"),
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.parquet").unlink()
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    name = "semi_and_anti"
    assert compare(spark, str(tmp_path), Q.QUERIES[name], Q.ORACLE[name]) == ""
    assert {r.doc_id for r in Q.QUERIES[name](spark, str(tmp_path)).collect() if r.reused} == {0, 1, 2, 3, 4, 5, 7, 8, 10}


@pytest.mark.parametrize("gone", ["llm", "pipeline", "both"])
def test_entry_works_without_the_optional_operators(tmp_path, gone):
    """With ``variorum/llm`` deleted (corpus_pipeline.py beside it or not), and with corpus_pipeline.py alone deleted."""
    import shutil
    from pathlib import Path

    root = Path(__file__).parent.parent
    if not (root / "variorum" / "llm").exists() and gone == "pipeline":
        pytest.skip("the operators are gone already")
    shutil.copytree(root / "variorum", tmp_path / "variorum", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if gone != "pipeline" else [])))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if gone == "llm" and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    ops = 13 if gone == "pipeline" else 0
    assert _entry(tmp_path) == [str(len(Q.QUERIES) + ops), str(ops), "False", "True"]


def _entry(folder, hidden=""):
    """What a new process finds in the entry of ``folder``, with the package ``hidden`` out of reach; nothing of the repository's own root is on its path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent.resolve()
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != root]
    code = f"import sys; sys.modules.update(dict.fromkeys({hidden.split()!r}))\n"
    code += "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    env = {"PATH": "/usr/bin:/bin", "HOME": str(folder), "PYTHONPATH": os.pathsep.join(path)}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=env).stdout.split()


def test_entry_works_without_packages_of_the_optional_operators(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "variorum", tmp_path / "variorum", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    for hidden in ("zstandard", "tokenizers sentencepiece public_tokenizers"):
        assert _entry(tmp_path, hidden) == [str(len(Q.QUERIES)), "0", "False", "True"]
