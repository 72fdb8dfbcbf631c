from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest stands alone when the optional folders and the pipeline are gone."""
    for name in ("__spark_entry__.py", "stagelight"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "stagelight"
    package.mkdir()
    for p in (ROOT / "stagelight").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'listing_page' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print('alone')"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert run.stdout.strip() == "alone", run.stderr
