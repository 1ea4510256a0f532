"""The entry works with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_the_corpus_subpackage(tmp_path):
    for name in ("siltstone", "__spark_entry__.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        if name == "siltstone":
            for p in (ROOT / name).rglob("*.py"):
                if "llm" not in p.relative_to(ROOT).parts:
                    to = tmp_path / p.relative_to(ROOT)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(p.read_text())
        else:
            (tmp_path / name).write_text((ROOT / name).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ev_quality_report' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "siltstone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "siltstone.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text()


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert "p1" in df.columns and df.count() == 1
