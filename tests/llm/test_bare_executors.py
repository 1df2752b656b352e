"""Every operator's query and the pipeline where only the driver can import the package, as on a cluster without a copy of it."""

import json
import os
import subprocess
import sys
import textwrap

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("BRINDLE_TEST_DATA", "/root/testdata/sf0.001")

RUN = """
    import json, sys
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")

    def there(_):
        import importlib.util

        yield importlib.util.find_spec("brindle") is not None

    assert spark.sparkContext.parallelize([1], 1).mapPartitions(there).collect() == [False], "workers can import the package"
    sys.path.insert(0, sys.argv[1])
    import __spark_entry__

    told = {}
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") or name == "pipeline":
            try:
                told[name] = query(spark, sys.argv[2]).count()
            except Exception as e:
                told[name] = str(e)[-300:]
    print("TOLD" + json.dumps(told))
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_operators_on_executors_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(RUN))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), ROOT, DATA], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert "TOLD" in done.stdout, done.stderr[-2000:]
    told = json.loads(done.stdout.split("TOLD")[1])
    assert len(told) >= 14
    assert {k: v for k, v in told.items() if not isinstance(v, int) or not v} == {}
