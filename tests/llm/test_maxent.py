"""The language model's tree."""

import numpy as np

from kinweave.llm import tree


def test_equal_events_are_worked_once(monkeypatch):
    worked = []
    steps = tree.Tree.steps
    monkeypatch.setattr(tree.Tree, "steps", lambda self, leaves: worked.append(len(leaves)) or steps(self, leaves))
    held = tree.Tree(np.array([50, 20, 10, 5]), np.full(8, 0.5))
    one, two, leaves = (np.array(x, dtype=np.int64) for x in zip(*[(1, 2, 3), (1, 2, 3), (2, 1, 0), (1, 2, 3), (12, 12, 1)] * 20, strict=True))
    fits = np.arange(100) % 3 > 0
    got = tree.train_and_score(held, one, two, leaves, fits, 2)
    assert sum(worked) == 6 and len(set(got.tolist())) == 3
    wide = tree.equal_events(one + (1 << 22), two, leaves)
    for first, back in (tree.equal_events(one, two, leaves), wide):
        assert len(first) == 3 and (one[first][back] == one).all() and (two[first][back] == two).all() and (leaves[first][back] == leaves).all()
