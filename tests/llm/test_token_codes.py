"""Chunks of token files against one bit after the other, for every width and first bit."""

import numpy as np
import pytest

from seatrace.llm import token_files


@pytest.mark.parametrize("width", range(1, 33))
def test_chunks_equal_plain_bits(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 100):
        values = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        whole = sum(int(v) << width * i for i, v in enumerate(values))
        data = token_files.packed(values, width)
        assert data == whole.to_bytes(-(-n * width // 8), "little")
        for first in range(1, n, 3):
            begin = first * width
            got = token_files.unpacked(data[begin // 8 :], begin % 8, width, n - first)
            assert got.tolist() == values[first:].tolist()


@pytest.mark.parametrize("high", [1, 2, 300, 1 << 19, 1 << 20, 1 << 32])
def test_ids_are_counted_by_their_bits(high):
    ids = np.random.default_rng(high).integers(0, high, 500, dtype=np.uint64).astype(np.uint32)
    bits = [int(i).bit_length() for i in ids]
    assert token_files._counts_by_bits(ids) == [bits.count(b) for b in range(33)]


def test_small_widths_need_no_wide_rows():
    """Values of a few bits were spread to 32 bytes each before: for 4 million of them 128 MB at once."""
    import tracemalloc

    data = token_files.packed(np.arange(1 << 22, dtype=np.uint32) & 7, 3)
    tracemalloc.start()
    token_files.unpacked(data, 0, 3, 1 << 22)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
