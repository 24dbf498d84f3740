"""The entry point without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_entry_without_llm(tmp_path):
    """Queries of the rest are there with the folders of the training-data operators gone, and with corpus_pipeline.py left or gone too."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "docsieve", tmp_path / "docsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from docsieve.llm import shared\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'policy_decision' in q and 'pipeline' not in q and e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
