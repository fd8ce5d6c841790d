from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from codeshoal.session import local_session  # noqa: E402

LANGUAGES = {"py": "python", "js": "javascript", "java": "java", "go": "go", "rb": "ruby",
             "ts": "typescript"}


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, memory="4g", app="tests")


@pytest.fixture(scope="session")
def make_files(spark):
    """Files table from a dict of path to content."""
    def make(contents: dict[str, str], repo: str = "r"):
        rows = [
            (i, repo, path, LANGUAGES.get(path.rsplit(".", 1)[-1]), text)
            for i, (path, text) in enumerate(contents.items())
        ]
        return spark.createDataFrame(
            rows, "file_id bigint, repo_id string, path string, language string, content string"
        )
    return make
