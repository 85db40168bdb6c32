"""A packed pool is handed on in parts, not as one table."""

import numpy as np

from quillon.llm import packing


def test_a_packed_pool_is_handed_on_in_small_parts():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 3 * packing.WINDOW, packing.POOL)
    texts = {i: rng.integers(0, 50_000, n).astype(np.uint32) for i, n in enumerate(sizes)}
    packer, parts = packing.Packer(5 << 40), []
    for i, ids in texts.items():
        packer.add(i, ids)
        parts += packer.drain()
    parts += packer.drain(last=True)
    assert len(parts) > 1 and max(sum(len(row[3]) for row in part) for part in parts) <= 4 * (packing.HANDED + packing.WINDOW)
    found: dict = {}
    for doc_id, start, length, ids, n, _, _ in (row for part in parts for row in part):
        assert len(ids) == 4 * length and n == len(texts[doc_id])
        found.setdefault(doc_id, []).append((start, ids))
    assert {i: b"".join(ids for _, ids in sorted(x)) for i, x in found.items()} == {i: ids.tobytes() for i, ids in texts.items()}


def test_a_long_text_is_handed_on_in_small_parts():
    ids = np.arange(4 * packing.HANDED, dtype=np.uint32)
    packer = packing.Packer(0)
    packer.add(1, ids)
    parts = list(packer.drain())
    assert [sum(row[2] for row in part) for part in parts] == [packing.HANDED] * 4
    assert b"".join(row[3] for part in parts for row in part) == ids.tobytes()
