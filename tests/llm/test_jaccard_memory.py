"""How much the shingles' tasks hold at once."""

import numpy as np
import pyarrow as pa

from kinweave.llm import jaccard


def test_profile_cuts_texts_in_small_pieces(monkeypatch):
    held = []
    cut = jaccard.Shingler.__call__
    monkeypatch.setattr(jaccard.Shingler, "__call__", lambda self, texts: held.append(sum(map(len, texts))) or cut(self, texts))
    texts = [b" ".join(b"w%d" % (i * 7 + j) for j in range(3000)) for i in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
    out = [r for b in jaccard._profile(5, 0)(iter([batch])) for r in b.to_pylist()]
    assert len(held) > 1 and max(held) <= 1 << 20 and sum(held) == sum(map(len, texts))
    counts = sum(int(np.frombuffer(r["counts"], "<u2").sum()) for r in out if r["kind"] == 1)
    assert counts == sum(r["n"] for r in out if r["kind"] == 0) == 150 * 2996
