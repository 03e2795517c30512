import subprocess
import sys
from pathlib import Path

from photoloom.session import Workspace, intermediate_tables


def folder(w):
    return Path(w.root.removeprefix("file://"))


def test_tables_go_with_their_scope(spark):
    outer = Workspace(spark, "kept")
    outer.write(spark.range(3), "t")
    with intermediate_tables():
        inner = Workspace(spark, "gone")
        assert inner.write(spark.range(5), "t").count() == 5
        with intermediate_tables():
            innermost = Workspace(spark, "gone")
        assert not folder(innermost).exists() and folder(inner).exists()
    assert folder(outer).exists() and not folder(inner).exists()
    outer.close()
    assert not folder(outer).exists()


def test_tables_go_with_the_application(tmp_path):
    program = f"""
import sys
sys.path[:0] = {[p for p in sys.path if p]!r}
from photoloom.session import Workspace, local_session
spark = local_session(1, "1g", **{{"spark.checkpoint.dir": "file://{tmp_path}/shared"}})
w = Workspace(spark, "t")
assert w.write(spark.range(3), "x").count() == 3
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list((tmp_path / "shared").glob("t-*"))
