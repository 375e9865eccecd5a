"""The logic scripts of tests/slt, each in a database of its own."""

from pathlib import Path

import pytest

from tidewater import slt
from tidewater.session import connect

SCRIPTS = sorted(Path(__file__).with_name("slt").glob("*.slt"))


@pytest.mark.parametrize("script", SCRIPTS, ids=lambda p: p.stem)
def test_script(spark, script):
    assert slt.run(connect(spark), script.read_text()) > 5
