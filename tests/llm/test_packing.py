import tracemalloc

import numpy as np
import pyarrow as pa

from trackspark.llm import language, packing
from trackspark.llm.queries import tokenizer_path
from trackspark.llm.shared import stretches


def test_letters_are_tokenised_once(monkeypatch):
    """The same letters with other marks, or met again, don't go to the tokenizer's model again."""
    e, asked = packing.Encoder(tokenizer_path()), []
    plain = e._letters
    monkeypatch.setattr(e, "_letters", lambda *unit: asked.append("".join(unit).strip()) or plain(*unit))
    texts = ["A somewhat, somewhat. somewhat! été, été.\nÉté somewhat", "B somewhat? été; été"]
    got = e.encode(texts)
    assert sorted(asked).count("somewhat") == 1 and sorted(asked).count("été") == 1
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(g).cast("I")) for g in got] == want


def peak(run, batch) -> float:
    """MB of Python and numpy objects that a task holds at most while it works through a batch."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_a_batch_is_never_held_whole_in_python(monkeypatch):
    """Ten thousand rows may come in one Arrow batch; tasks make Python objects of a bounded stretch of it at a time."""
    texts = pa.array(["word " * 800] * 8000)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(8000)), "source": pa.array(["a"] * 8000), "text": texts})

    class Tokens:
        def encode(self, texts):
            return [b"\0\0\0\0"] * len(texts)

    monkeypatch.setattr(packing, "encoder", lambda path: Tokens())
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    assert peak(packing._packs("", 0, 1_000_000), batch) < 8  # 34 MB of text
    letters = np.random.default_rng(1).integers(0xAC00, 0xAC28, (300, 20_000)).astype("<u4")
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["ko"] * 300), "text": pa.array([x.tobytes().decode("utf-32-le") for x in letters])})
    assert peak(language._count("lang", "text"), batch) < 100  # five million n-grams


def test_stretches_are_all_rows_in_order():
    texts = pa.array(["a" * n if n % 3 else None for n in [5, 0, 300, 7, 1, 2, 90, 100, 4]])
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(9)), "text": texts})
    for most in (1, 100, 1000):
        parts = list(stretches(batch, 1, most))
        assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= most for p in parts)
    assert list(stretches(batch.slice(0, 0), 1)) == []
