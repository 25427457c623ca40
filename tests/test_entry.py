"""The entry point without the optional queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_point_without_the_optional_folders(tmp_path):
    for name in ("cartulary", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for pipeline in (True, False):
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        shutil.rmtree(tmp_path / "cartulary" / "llm", ignore_errors=True)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'card_scores' in q and set(o) <= set(q) and not any(n.startswith('op') and n[2:3].isdigit() for n in q), sorted(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
