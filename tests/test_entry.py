import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_optional_folder(tmp_path):
    """The entry point imports and lists the other queries where the optional folder and the pipeline are gone."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('corpusloom.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "assert q and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_rows(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["duplicate_kind", "review_state", "n_links", "n_in_band"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_folder():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
