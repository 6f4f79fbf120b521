"""Written tables go when they are no longer needed."""

import os
import subprocess
import sys
import tempfile

from tests.conftest import ROOT, SF_SMALL
from textpairs.plans.registry import QUERIES, load_all
from textpairs.session import cuts, drop_cuts, materialise, scratch_path

load_all()


def files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


def local(path):
    return path.removeprefix("file:")


def test_cuts_block_leaves_nothing(spark):
    base = os.path.dirname(local(scratch_path(spark, "probe")))
    before = set(files(base))
    with cuts(spark):
        kept = QUERIES["split_stratified"](spark, SF_SMALL).count()
        QUERIES["ema"](spark, SF_SMALL).count()
        assert kept and set(files(base)) - before
    assert set(files(base)) == before


def test_blocks_nest_and_keep_what_was_there(spark):
    outer = materialise(spark.range(5))
    with cuts(spark):
        middle = materialise(spark.range(6))
        with cuts(spark):
            assert materialise(spark.range(7)).count() == 7
        assert middle.count() == 6
    assert outer.count() == 5
    path = local(outer.inputFiles()[0])
    drop_cuts(spark)
    assert not os.path.exists(path)


def test_nothing_is_left_after_the_application(tmp_dir):
    shared = tempfile.mkdtemp(prefix="textpairs-test-shared-")
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from textpairs.session import build_session
import __spark_entry__ as E
spark = build_session("local[2]", partitions=4, conf={{"spark.checkpoint.dir": {shared!r}}})
queries = E.queries()
for key in ("sortish_batches", "kept_ids_file", "stream_ema"):
    assert queries[key](spark, {SF_SMALL!r}).count()
import os
assert any(f for _, _, fs in os.walk({shared!r}) for f in fs)
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert files(shared) == []
