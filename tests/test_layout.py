"""The rest works without the corpus subpackage, and nothing in it imports that."""

import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quarrylane").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "quarrylane").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("quarrylane.llm") for n in names), path


def test_entry_without_the_subpackage(tmp_path):
    for item in ("quarrylane", "__spark_entry__.py"):
        source = ROOT / item
        target = tmp_path / item
        if source.is_dir():
            for f in source.rglob("*.py"):
                if "llm" not in f.relative_to(source).parts:
                    (target / f.relative_to(source)).parent.mkdir(parents=True, exist_ok=True)
                    (target / f.relative_to(source)).write_text(f.read_text())
        else:
            target.write_text(source.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1') for q in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, corpus, sql = out.stdout.split()
    assert int(n) > 80 and corpus == "False" and int(sql) > 80


def test_entry_without_a_library_of_the_subpackage():
    """Where a library that only the subpackage needs is absent, the other queries stay."""
    hide = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1') for q in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, corpus, sql = out.stdout.split()[-3:]
    assert int(n) > 80 and corpus == "False" and int(sql) > 80
