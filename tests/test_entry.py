"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def entry_keys(folder):
    code = "import __spark_entry__ as E; print(' '.join(sorted(E.queries()))); print(len(E.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    return done, done.stdout.split("\n")[0].split()


def copy_of(folder, without=()):
    shutil.copytree(os.path.join(ROOT, "textpairs"), os.path.join(folder, "textpairs"),
                    ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)) and name not in without:
            shutil.copy(os.path.join(ROOT, name), folder)


def test_queries_without_the_subpackage(tmp_dir):
    copy_of(tmp_dir, without=("llm", "corpus_pipeline.py"))
    done, keys = entry_keys(tmp_dir)
    assert done.returncode == 0, done.stderr[-1000:]
    assert "nli_split_counts" in keys and len(keys) > 100
    assert not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in keys)


def test_an_import_error_inside_the_subpackage_is_not_hidden(tmp_dir):
    copy_of(tmp_dir, without=("llm", "corpus_pipeline.py"))
    os.mkdir(os.path.join(tmp_dir, "textpairs", "llm"))
    open(os.path.join(tmp_dir, "textpairs", "llm", "__init__.py"), "w").close()
    with open(os.path.join(tmp_dir, "textpairs", "llm", "queries.py"), "w") as f:
        f.write("import a_missing_dependency\n")
    done, _ = entry_keys(tmp_dir)
    assert done.returncode != 0 and "a_missing_dependency" in done.stderr
