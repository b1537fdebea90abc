import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quorumlake.session import session

    out = session(cpus=4, memory="6g", partitions=4)
    out.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield out
    out.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
