"""What the code of the training-data operators may not hold."""

from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
FILES = [*sorted((ROOT / "weaklabel" / "llm").glob("*.py")), ROOT / "corpus_pipeline.py"]


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.name)
def test_no_forbidden_calls(path):
    text = path.read_text()
    for word in ("localCheckpoint", "crossJoin(", ".rdd", "toPandas(", "except ImportError", "find_spec"):
        assert word not in text, (path.name, word)


#: Broadcasts of proven size: the learned lexicon, cut to a fixed number of words, and one row an id range.
BOUNDED = {"toxicity.py", "edit_fingerprint.py"}


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.name)
def test_broadcasts_are_of_proven_size(path):
    assert "broadcast(" not in path.read_text() or path.name in BOUNDED
