"""What a reused Python worker holds between tasks."""

import numpy as np
import pyarrow as pa

from adipose.llm import near_dup, quality
from adipose.llm import text_arrays as ta


def test_slices_keep_the_table_of_powers_at_a_million(monkeypatch):
    monkeypatch.setattr(ta, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = [f"some words of text number {k} " * 2_000 for k in range(100)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    done = list(quality._features(iter([batch]))), list(near_dup._sign(80)(iter([batch])))
    assert [sum(x.num_rows for x in d) for d in done] == [len(texts)] * 2
    assert len(ta._POWERS[0]) <= 1 << 20 and sum(map(len, texts[:-2])) > 4 << 20
