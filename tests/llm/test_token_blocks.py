"""Blocks of the token files: places of exceptions, and the format read by hand."""

import numpy as np
import pyarrow as pa

from scoreloom.llm import stretches, token_files


def test_exception_places():
    """Of blocks that end at 10, 12 and 30 (units of two bytes) with 2, 0 and 1 exceptions: positions first, then values."""
    block, position, value = token_files.exception_places(np.array([10, 12, 30]), np.array([2, 0, 1]))
    assert (block.tolist(), position.tolist(), value.tolist()) == ([0, 0, 2], [4, 5, 27], [6, 8, 28])


def test_format_of_blocks():
    """Every block, read alone as the format says, holds its ids; exceptions in all blocks, in none, and of 32 bits."""
    rng = np.random.default_rng(3)
    small = rng.integers(0, 900, 1000)
    for ids in (small, np.where(rng.random(1000) < 0.05, (1 << 32) - 1, small), np.full(1000, 7), np.where(np.arange(1000) == 130, 1 << 31, 0)):
        ids = ids.astype(np.uint32)
        got = token_files.Segment(token_files.encode_segment([1], np.array([len(ids)]), ids))
        assert (got.ids() == ids).all() and (got.ids(2, 5) == ids[256:640]).all()
        for i in range(got.blocks):
            raw, w, k = got.raw[got.at + got.starts[i] : got.at + got.starts[i + 1]], int(got.width[i]), int(got.exceptions[i])
            number, out = int.from_bytes(raw[: 16 * w], "little"), []
            assert len(raw) == 16 * w + 6 * k
            for j in range(128):
                out.append((number >> (j * w)) & ((1 << w) - 1))
            for j, x in zip(np.frombuffer(raw, "<u2", k, 16 * w).tolist(), np.frombuffer(raw, "<u4", k, 16 * w + 2 * k).tolist()):
                out[j] = x
            own = ids[128 * i : 128 * i + 128].tolist()
            assert [x + int(got.low[i]) for x in out][: len(own)] == own


def test_known_stretches_are_not_hashed_again(monkeypatch):
    """The table that a slice makes for its lookup has its own stretches, not all that are known; ids stay the same."""
    sizes, index_in = [], stretches.pc.index_in

    def seen(values, value_set):
        sizes.append(len(value_set))
        return index_in(values, value_set=value_set)

    encoder = stretches.StretchEncoder(lambda text: [ord(c) for c in text])
    encoder.run(pa.array([" ".join(f"w{i}" for i in range(5000))]))
    monkeypatch.setattr(stretches.pc, "index_in", seen)
    texts = ["w1 w2 new w1", "w7 new", ""]
    flat, count = encoder.run(pa.array(texts))
    assert "".join(map(chr, flat.tolist())) == "".join(texts) and count.tolist() == [len(t) for t in texts]
    assert sizes and max(sizes) <= 8
