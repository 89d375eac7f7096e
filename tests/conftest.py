import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from episodic.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="episodic-tests")
    # small blocks / hot threshold so every episode operator runs its multi-block and
    # hot-episode paths on the small fixtures
    s.conf.set("episodic.episodeBlockRows", "16")
    s.conf.set("episodic.hotEpisodeRows", "40")
    yield s
    s.stop()
