import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "label" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_part(tmp_path):
    """The rest imports and registers its queries where the llm folders and corpus_pipeline.py are gone."""
    import shutil

    shutil.copytree(ROOT / "candlewick", tmp_path / "candlewick", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = textwrap.dedent("""
        import __spark_entry__ as e
        assert len(e.queries()) > 40 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries()
    """)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
