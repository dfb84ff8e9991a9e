import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])
    from ramify.session import session

    shared = tmp_path_factory.mktemp("shared")
    out = session("tests", "local[4]", **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_driver_memory": "4g", "spark_checkpoint_dir": f"file://{shared}"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
