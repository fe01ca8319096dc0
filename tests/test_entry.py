import ast
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 22


def test_flagship(spark, monkeypatch):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    out = entry.entry(spark)
    assert out.columns == ["id", "name", "hash"] and out.count() > 100


def test_the_registry_stands_alone():
    """Nothing outside the corpus folders imports them, and the entry works without them."""
    for path in [*ROOT.glob("rollcall/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in path.relative_to(ROOT).parts or path.name == "corpus_pipeline.py":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("rollcall.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) >= 22 and "pipeline" not in e.queries() and "flagship" in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_an_empty_folder_is_no_corpus(tmp_path):
    """What a removal may leave, a folder with compiled files alone, counts as removed."""
    import shutil

    for x in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / x).exists():
            shutil.copy(ROOT / x, tmp_path / x)
    shutil.copytree(ROOT / "rollcall", tmp_path / "rollcall", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "rollcall" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'flagship' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
